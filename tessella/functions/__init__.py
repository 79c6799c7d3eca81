"""Part of the tessella engine; see the README for the layout."""
