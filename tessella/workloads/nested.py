from tessella.operators.nested import flatten_records, path_summary, record_nodes, record_tables
from tessella.plans.catalog import query, table


@query()
def p1_found(spark, d):
    return flatten_records(table(spark, d, "init_records")).select("record_id", "child", "parent", "name").distinct()


@query()
def p1_servers(spark, d):
    return record_tables(table(spark, d, "init_records"))["mcp_server"]


@query()
def p1_plugins(spark, d):
    return record_tables(table(spark, d, "init_records"))["plugin"]


@query()
def p1_tools(spark, d):
    return record_tables(table(spark, d, "init_records"))["tool"]


@query()
def p1_nodes(spark, d):
    """Every node of every record, with its label and the label of the node around it."""
    return record_nodes(table(spark, d, "init_records")).distinct()


@query()
def p1_tables(spark, d):
    return path_summary(record_nodes(table(spark, d, "init_records")))
