"""Queries on time, versions, provenance, queues, structured text, paths and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.functions.scalars import accent_map, LETTER_PAIRS, parse_hstore, trigram_similarity, unaccent, uuidv7
from rankweave.operators import assertions, predicates, provenance, queue
from rankweave.operators.graph import Graph, Hop, match_path, path_query, traverse
from rankweave.operators.hierarchy import hierarchy_rollup
from rankweave.operators.query import Or
from rankweave.operators.semistructured import json_schema_check, violation_summary, xml_table
from rankweave.operators.similar import trigram_join
from rankweave.operators.text_index import FrameIndex, StoredIndex
from rankweave.operators.text_search import search
from rankweave.operators.timeseries import chunk_catalog, chunks, partition_plan, read_chunked, time_bucket, write_chunked
from rankweave.operators.versioned import Line, VersionedTable, conflict_rows, diff_branch, inverse_changes, merge_branches, merge_changes, read_branch
from rankweave.plans.text import TOKENS, bm25_sql
from rankweave.session import broadcast_if_small, work_path
from rankweave.sources import table
from rankweave.streaming.streams import read_queue_state, stream_into_index, stream_queue_state, stream_time_bucket

# -- time ------------------------------------------------------------------------


def _events(spark, folder) -> DataFrame:
    return table(spark, folder, "events")


def time_bucket_agg(spark, folder):
    return time_bucket(
        _events(spark, folder), "ts", "15 minutes",
        [F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"), F.max("value").alias("high")],
        by=["event_type"],
    )


def time_bucket_weeks(spark, folder):
    return time_bucket(_events(spark, folder), "ts", "7 days", [F.count("*").alias("n"), F.min("ts").alias("first_ts")])


def chunk_catalog_rows(spark, folder):
    return chunk_catalog(_events(spark, folder), "ts", "6 hours")


def _written_chunks(spark, folder) -> str:
    path = work_path(spark, "chunked")
    write_chunked(_events(spark, folder), "ts", "6 hours", path)
    return path


def chunks_on_disk(spark, folder):
    return chunks(spark, _written_chunks(spark, folder), "ts")


def chunk_range_read(spark, folder):
    path = _written_chunks(spark, folder)
    rows = read_chunked(spark, path, "ts", "6 hours", "2024-01-10 03:00:00", "2024-01-12 09:30:00")
    return rows.select("event_id", "ts", "value")


def partition_plan_rows(spark, folder):
    return partition_plan(table(spark, folder, "lineitem"), "l_orderkey", 1000)


# -- versions --------------------------------------------------------------------

KEY = ["o_orderkey"]
COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
FORK = [Line("main", 1)]
MAIN = [Line("main")]
REVIEW = [Line("review"), Line("main", 1)]


def _orders(spark, folder) -> DataFrame:
    return table(spark, folder, "orders").select(*COLUMNS)


def _log(spark, folder) -> DataFrame:
    """A history over all orders.

    Version 1 on main marks urgent finished orders. Version 2 on the branch review
    refunds the finished ones of high value, raises the price of pending high
    priority ones and deletes pending low ones. Version 3 on main marks the dear
    half of the finished ones and deletes pending urgent ones.
    """
    orders = _orders(spark, folder)

    def change(version: int, branch: str, op: str, where: str, **new):
        rows = orders.where(where)
        for name, value in new.items():
            rows = rows.withColumn(name, F.expr(value))
        return rows.select(*COLUMNS, F.lit(version).cast("long").alias("version"), F.lit(branch).alias("branch"), F.lit(op).alias("op"))

    done = "o_orderstatus = 'F' and "
    parts = [
        change(1, "main", "upsert", done + "o_orderpriority = '1-URGENT'", o_orderpriority="'0-NOW'"),
        change(2, "review", "upsert", done + "o_totalprice > 200000", o_orderstatus="'R'"),
        change(2, "review", "upsert", "o_orderstatus = 'P' and o_orderpriority = '2-HIGH'", o_totalprice="o_totalprice + 100"),
        change(2, "review", "delete", "o_orderstatus = 'P' and o_orderpriority = '5-LOW'"),
        change(3, "main", "upsert", done + "o_totalprice > 300000 and o_orderpriority <> '1-URGENT'", o_orderstatus="'X'"),
        change(3, "main", "upsert", "o_orderstatus = 'P' and o_orderpriority = '2-HIGH'", o_orderpriority="'2-NEXT'"),
        change(3, "main", "delete", "o_orderstatus = 'P' and o_orderpriority = '1-URGENT'"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def version_read(spark, folder):
    return read_branch(_orders(spark, folder), _log(spark, folder), KEY, REVIEW)


def version_as_of(spark, folder):
    return read_branch(_orders(spark, folder), _log(spark, folder), KEY, FORK)


def version_diff(spark, folder):
    return diff_branch(_orders(spark, folder), _log(spark, folder), KEY, FORK, "review")


def _merge(spark, folder) -> DataFrame:
    return merge_branches(_orders(spark, folder), _log(spark, folder), KEY, MAIN, FORK, "review")


def version_conflicts(spark, folder):
    return conflict_rows(_merge(spark, folder), KEY)


def version_merge(spark, folder):
    """What a merge would commit on the keys that are not in conflict."""
    return merge_changes(_merge(spark, folder), KEY)


def version_undo(spark, folder):
    """The changes that lead main back to version 1."""
    orders, log = _orders(spark, folder), _log(spark, folder)
    before = read_branch(orders, log, KEY, FORK)
    after = read_branch(orders, log, KEY, MAIN)
    return inverse_changes(before, after, KEY)


# -- provenance ------------------------------------------------------------------


def _customers(spark, folder) -> DataFrame:
    rows = table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return provenance.add_provenance(rows, "customer", ["c_custkey"])


def _order_tokens(spark, folder) -> DataFrame:
    rows = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return provenance.add_provenance(rows, "orders", ["o_orderkey"])


def prov_distinct_formula(spark, folder):
    customers = _customers(spark, folder)
    names = provenance.provenance_mapping(customers, "c_name")
    return provenance.sr_formula(provenance.project(customers, "c_nationkey", "c_mktsegment"), names)


def prov_join_count(spark, folder):
    customers = _customers(spark, folder).withColumnRenamed("c_custkey", "o_custkey")
    joined = provenance.join(customers, _order_tokens(spark, folder), ["o_custkey"])
    return provenance.sr_counting(provenance.project(joined, "c_nationkey", "o_orderstatus"))


def prov_weighted_count(spark, folder):
    """Derivations of customer and order, each order counting by its status."""
    customers = _customers(spark, folder).withColumnRenamed("c_custkey", "o_custkey")
    orders = _order_tokens(spark, folder)
    weights = provenance.provenance_mapping(
        orders.withColumn("w", F.when(F.col("o_orderstatus") == "F", 3).otherwise(1)), "w"
    )
    joined = provenance.join(customers, orders, ["o_custkey"])
    return provenance.sr_counting(provenance.project(joined, "c_nationkey"), weights)


def prov_why(spark, folder):
    """Number of witnesses and of the source rows in them, per nation and status."""
    customers = _customers(spark, folder).withColumnRenamed("c_custkey", "o_custkey")
    joined = provenance.join(customers, _order_tokens(spark, folder), ["o_custkey"])
    witnesses = provenance.why(provenance.project(joined, "c_nationkey", "o_orderstatus"))
    return witnesses.groupBy("c_nationkey", "o_orderstatus").agg(
        F.count("*").alias("n_witnesses"), F.sum(F.size("witness")).cast("long").alias("n_tokens")
    )


def _order_chances(spark, folder) -> DataFrame:
    chance = F.when(F.col("o_orderstatus") == "F", 1 / 3).when(F.col("o_orderstatus") == "O", 2 / 7).otherwise(1 / 7)
    return provenance.provenance_mapping(_order_tokens(spark, folder).withColumn("p", chance), "p").withColumnRenamed("value", "p")


def prov_probability(spark, folder):
    orders = _order_tokens(spark, folder)
    return provenance.probability(provenance.project(orders, "o_custkey"), _order_chances(spark, folder))


def prov_join_probability(spark, folder):
    """A line item is there when its order and its supplier are."""
    orders = _order_tokens(spark, folder).withColumnRenamed("o_orderkey", "l_orderkey")
    # Dealt once, as the join needs them; orders with tokens are larger than Spark's estimate.
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey").repartition("l_orderkey").distinct().hint("merge")
    suppliers = provenance.add_provenance(
        table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey")), "supplier", ["l_suppkey"]
    )
    kept = provenance.join(orders.join(items, "l_orderkey"), suppliers, ["l_suppkey"])
    chances = _order_chances(spark, folder).union(
        provenance.provenance_mapping(suppliers.withColumn("p", F.lit(0.9)), "p")
    )
    return provenance.probability(provenance.project(kept, "l_orderkey", "l_suppkey"), chances)


def _order_suppliers(spark, folder):
    """Orders with the suppliers of their items: a row for each order, derivations share its token."""
    orders = provenance.add_provenance(
        table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "orders", ["l_orderkey"]
    )
    # Dealt once, as the join needs them; orders with tokens are larger than Spark's estimate.
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey").repartition("l_orderkey").distinct().hint("merge")
    suppliers = provenance.add_provenance(
        table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey")), "supplier", ["l_suppkey"]
    )
    return orders, suppliers, provenance.join(orders.join(items, "l_orderkey"), suppliers, ["l_suppkey"])


def prov_dependent_probability(spark, folder):
    orders, suppliers, kept = _order_suppliers(spark, folder)
    chances = provenance.provenance_mapping(orders.withColumn("p", F.lit(0.5)), "p").union(
        provenance.provenance_mapping(suppliers.withColumn("p", F.lit(0.25)), "p")
    ).withColumnRenamed("value", "p")
    return provenance.probability(provenance.project(kept, "l_orderkey"), chances)


def prov_dependent_shapley(spark, folder):
    return provenance.shapley(provenance.project(_order_suppliers(spark, folder)[2], "l_orderkey"))


def prov_expected_sum(spark, folder):
    """Orders and their worth that each customer may expect, where an order needs itself and one of its suppliers."""
    orders, suppliers, kept = _order_suppliers(spark, folder)
    chances = provenance.provenance_mapping(orders.withColumn("p", F.lit(0.5)), "p").union(
        provenance.provenance_mapping(suppliers.withColumn("p", F.lit(0.25)), "p")
    ).withColumnRenamed("value", "p")
    worth = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_totalprice")
    rows = provenance.project(kept.join(worth, "l_orderkey"), "l_orderkey", "o_custkey", "o_totalprice")
    return provenance.expected(rows, chances, ["o_custkey"], "o_totalprice")


def prov_where_join(spark, folder):
    orders, suppliers, kept = _order_suppliers(spark, folder)
    tables = {"l_orderkey": ("orders", orders), "l_suppkey": ("supplier", suppliers)}
    return provenance.where(kept, tables)


def prov_shapley(spark, folder):
    return provenance.shapley(provenance.project(_order_tokens(spark, folder), "o_custkey"))


def prov_banzhaf(spark, folder):
    return provenance.banzhaf(provenance.project(_order_tokens(spark, folder), "o_custkey"))


# -- queues ----------------------------------------------------------------------

NOW = "2024-01-16 00:00:00"


def _queue_log(spark, folder) -> DataFrame:
    """The events as the log of five queues, one per event type.

    Every event is a message sent at its time. Those of value over 40 were read an
    hour later and hidden for as many hours as their value; those of k below 20 were
    archived two hours after being sent.
    """
    events = _events(spark, folder).withColumn("k", F.get_json_object("props", "$.k").cast("int"))

    def rows(op, ts, vt, message, where):
        return events.where(where).select(
            F.col("event_type").alias("queue"), F.expr(ts).alias("event_ts"), F.lit(op).alias("op"),
            F.col("event_id").alias("msg_id"), F.expr(message).alias("message"), F.expr(vt).cast("timestamp").alias("vt"),
        )

    sent = rows("send", "ts", "null", "props", "true")
    read = rows(
        "read", "ts + interval 1 hour", "timestampadd(HOUR, cast(floor(value) as int), ts)", "cast(null as string)", "value > 40"
    )
    filed = rows("archive", "ts + interval 2 hours", "null", "cast(null as string)", "k < 20")
    return sent.unionByName(read).unionByName(filed)


def queue_visible(spark, folder):
    seen = queue.visible(_queue_log(spark, folder), NOW)
    return seen.select("queue", "msg_id", "message", "sent_at", "read_ct")


def queue_read(spark, folder):
    return queue.read_each(_queue_log(spark, folder), 10, NOW)


def queue_archive(spark, folder):
    return queue.archived(_queue_log(spark, folder)).select("queue", "msg_id", "message", "archived_at")


def queue_log_range(spark, folder):
    """The log of message numbers 100 to 299, out of a log with a folder for each 100 numbers."""
    path = work_path(spark, "queue-log")
    queue.append(_queue_log(spark, folder), path, width=100)
    return queue.open_log(spark, path, 100, first=100, last=299).select("queue", "msg_id", "op", "event_ts")


def time_ordered_ids(spark, folder):
    """Version 7 ids of the events; the variant digit is checked and masked."""
    events = _events(spark, folder).select("event_id", uuidv7(F.col("ts").cast("timestamp"), F.col("event_id")).alias("u"))
    return events.select(
        "event_id", F.overlay("u", F.lit("?"), 20).alias("stem"), F.substring("u", 20, 1).isin(*"89ab").alias("variant_ok")
    )


def hstore_maps(spark, folder):
    """Sources and languages out of key-value text with quotes, commas, escapes and NULL."""
    quoted = F.concat(F.lit('"'), F.regexp_replace("source", r'(["\\\\])', r"\\$1"), F.lit(', \\"=>\\\\"'))
    said = F.concat(
        F.lit("id=>"), F.col("doc_id").cast("string"), F.lit(', "the source"=>'), F.coalesce(quoted, F.lit("NULL")),
        F.lit(",lang => "), F.coalesce("lang", F.lit("null")),
    )
    docs = table(spark, folder, "documents").select("doc_id", parse_hstore(said).alias("m"))
    return docs.select(
        "doc_id", F.col("m")["id"].alias("id"), F.col("m")["the source"].alias("source"), F.col("m")["lang"].alias("lang"),
        F.size("m").cast("long").alias("n_keys"),
    )


# -- JSON, XML, similarity, paths --------------------------------------------------

SCHEMA = {
    "type": "object",
    "required": ["k"],
    "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 90}},
    "additionalProperties": False,
}


def json_check(spark, folder):
    checked = json_schema_check(_events(spark, folder).select("event_id", "props"), "props", SCHEMA)
    return checked.select("event_id", "valid", F.array_join(F.transform("violations", lambda v: v["rule"]), ",").alias("rules"))


def json_summary(spark, folder):
    return violation_summary(json_schema_check(_events(spark, folder).select("props"), "props", SCHEMA))


LINES = {
    "type": "object",
    "required": ["lines"],
    "properties": {
        "lines": {
            "type": "array",
            "items": {
                "type": "object",
                "required": ["flag"],
                "properties": {
                    "q": {"type": "integer", "maximum": 45},
                    "flag": {"enum": ["N", "A"]},
                    "parts": {"type": "array", "items": {"type": "integer", "minimum": 20}},
                },
            },
        }
    },
}


def json_items(spark, folder):
    """Orders written as nested JSON: rules of their lines and of the numbers in a line."""
    items = table(spark, folder, "lineitem")
    line = F.struct(
        (F.col("l_quantity").cast("double") + F.when(F.col("l_linenumber") == 3, 0.5).otherwise(0.0)).alias("q"),
        F.when(F.col("l_linenumber") != 5, F.col("l_returnflag")).alias("flag"),
        F.array("l_partkey", "l_suppkey").alias("parts"),
    )
    orders = items.groupBy("l_orderkey").agg(F.to_json(F.struct(F.collect_list(line).alias("lines"))).alias("doc"))
    checked = json_schema_check(orders, "doc", LINES)
    said = F.transform("violations", lambda v: F.concat_ws(" ", v["rule"], v["path"]))
    return checked.select("l_orderkey", "valid", F.array_join(said, ",").alias("rules"))


def xml_rows(spark, folder):
    """Customers written as XML and read back as a table."""
    customers = table(spark, folder, "customer")
    xml = F.concat(
        F.lit("<doc><rows><row seg='"), "c_mktsegment", F.lit("'><name>"), "c_name", F.lit("</name></row><row seg='n'><name>"),
        F.col("c_nationkey").cast("string"), F.lit("</name></row></rows></doc>"),
    )
    rows = xml_table(customers.select("c_custkey", xml.alias("x")), "x", "/doc/rows/row", {"@seg": "string", "name": "string"})
    return rows


def trigram_scores(spark, folder):
    part = table(spark, folder, "part")
    score = trigram_similarity(F.col("p_name"), F.concat_ws(" ", "p_type", "p_name", "p_brand"))
    return part.select("p_partkey", F.round(score, 6).alias("similarity"))


def trigram_pairs(spark, folder):
    names = table(spark, folder, "customer")
    return trigram_join(names, "c_name", names, "c_name", 0.75, same_table=True)


def trigram_part_pairs(spark, folder):
    part = table(spark, folder, "part")
    return trigram_join(part, "p_name", part, "p_name", 0.3, same_table=True)


def rollup(spark, folder):
    customers = table(spark, folder, "customer")
    nations = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    paths = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat_ws(".", F.regexp_replace("r_name", " ", "_"), "n_name", "c_mktsegment").alias("path"), "c_acctbal"
    )
    return hierarchy_rollup(paths, "path", [F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance")])


def unaccented(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return docs.select("doc_id", unaccent(F.col("text")).alias("plain"))


# -- graph -----------------------------------------------------------------------


def _graph(spark, folder) -> Graph:
    """Customers place orders; orders hold items of suppliers."""
    customer, orders = table(spark, folder, "customer"), table(spark, folder, "orders")
    supplier, lineitem = table(spark, folder, "supplier"), table(spark, folder, "lineitem")
    named = lambda prefix, key: F.concat(F.lit(prefix), F.col(key).cast("string"))
    vertices = (
        customer.select(named("c", "c_custkey").alias("id"), F.lit("customer").alias("label"), F.col("c_nationkey").alias("nation"))
        .union(orders.select(named("o", "o_orderkey"), F.lit("order"), F.lit(None).cast("int")))
        .union(supplier.select(named("s", "s_suppkey"), F.lit("supplier"), "s_nationkey"))
    )
    edges = orders.select(
        named("c", "o_custkey").alias("src"), named("o", "o_orderkey").alias("dst"), F.lit("placed").alias("label")
    ).union(
        lineitem.select(named("o", "l_orderkey"), named("s", "l_suppkey"), F.lit("holds")).distinct()
    )
    return Graph(vertices, edges, "trade")


def graph_two_hop(spark, folder):
    """Walks from customers of one nation over their orders to its suppliers."""
    walk = match_path(
        _graph(spark, folder), [Hop(edge="label = 'placed'"), Hop(edge="label = 'holds'", node="label = 'supplier' and nation = 3")],
        start="label = 'customer' and nation = 3",
    )
    return walk


def graph_traverse(spark, folder):
    graph = _graph(spark, folder)
    start = graph.vertices.where("label = 'customer' and nation = 7").select("id")
    return traverse(graph, start, 3)


def graph_traverse_deep(spark, folder):
    graph = _graph(spark, folder)
    start = graph.vertices.where("label = 'supplier' and nation = 7").select("id")
    return traverse(graph, start, 5, directed=False)


def path_query_rows(spark, folder):
    rows = path_query(_events(spark, folder), by={"event_type": "error"}, order="ts", last=25)
    return rows.select("event_id", "ts", "user_id", "value")


# -- predicates and assertions -----------------------------------------------------


LABELS = {"0": "nothing to object to", "1": "toxic"}
LABEL_ROWS = 1_500_000


def _toxic_model(spark, folder):
    """Naive Bayes of the labelled documents."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    # Two numbers a row, so more rows are broadcast than of others; else all texts are dealt.
    labels = broadcast_if_small(table(spark, folder, "labels").select("doc_id", "toxic"), LABEL_ROWS)
    labelled = docs.join(labels, "doc_id")
    return predicates.NaiveBayes.fit(labelled, "text", "toxic", yes="1")


def _classified(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return predicates.classify(docs, "text", "Is it toxic?", LABELS, _toxic_model(spark, folder))


def classify_batch(spark, folder):
    return _classified(spark, folder).select(
        "doc_id", "choice", F.round("confidence", 6).alias("confidence"), "model", "input_tokens", "output_tokens"
    )


def classify_stats(spark, folder):
    return predicates.eval_stats(_classified(spark, folder))


def row_filter_rows(spark, folder):
    """Documents that their language and source alone make out to be long."""
    docs = table(spark, folder, "documents").select("lang", "source", (F.col("n_chars") > 1000).cast("string").alias("long"))
    rows = docs.select(F.to_json(F.struct("lang", "source")).alias("row"), "long")
    model = predicates.NaiveBayes.fit(rows, "row", "long", yes="true")
    plain = table(spark, folder, "documents").select("lang", "source")
    kept = predicates.row_filter(plain, "the document is long", model, threshold=0.7)
    return kept.groupBy("lang", "source").agg(F.count("*").alias("n"))


def yes_no_scores(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = predicates.yes_no(docs, "text", "Is it toxic?", "toxic", "harmless", _toxic_model(spark, folder))
    return out.select("doc_id", F.round("number", 6).alias("number"))


def assert_table_results(spark, folder):
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    items = table(spark, folder, "lineitem")
    counted = orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    again = orders.select("o_custkey").withColumn("one", F.lit(1)).groupBy("o_custkey").agg(F.sum("one").alias("n"))
    lost = orders.join(customer, orders["o_custkey"] == customer["c_custkey"], "left_anti")
    return assertions.assert_tables(
        spark,
        [
            assertions.rows_equal(counted, again, "counts agree"),
            assertions.rows_equal(
                orders.select("o_orderkey"), orders.where("o_orderstatus <> 'F'").select("o_orderkey"), "nothing is finished"
            ),
            assertions.is_empty(lost, "every order has a customer"),
            assertions.holds_for_all(items, "l_quantity > 0", "quantities are positive"),
            assertions.holds_for_all(items, "l_quantity > 10", "quantities are large"),
            assertions.is_unique(orders, ["o_orderkey"], "order keys are unique"),
            assertions.is_unique(orders, ["o_custkey"], "one order per customer"),
            assertions.has_columns(orders, ["o_orderkey", "o_nothing"], "orders have their columns"),
        ],
    )


def version_cycle(spark, folder):
    """Track, branch, commit, merge, change both sides, merge again, undo: two states of main."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    held = VersionedTable.track(orders, "o_orderkey", work_path(spark, "versions"))
    held.create_branch("review")
    held.commit("review", orders.where("o_orderkey % 5 = 0").withColumn("o_orderstatus", F.lit("X")))
    held.merge("review")
    held.commit("main", held.read().where("o_orderkey % 7 = 0").withColumn("o_totalprice", F.lit(0) * F.col("o_totalprice")))
    held.commit("review", held.read("review").where("o_orderkey % 10 = 0").withColumn("o_orderstatus", F.lit("Y")))
    merged, _ = held.merge("review")
    held.undo_merge(merged)
    states = held.read("main", merged).withColumn("state", F.lit("merged"))
    return states.unionByName(held.read().withColumn("state", F.lit("undone")))


def version_savepoint(spark, folder):
    """What going back to a savepoint does, and how many rows differ from it afterwards."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    held = VersionedTable.track(orders, "o_orderkey", work_path(spark, "versions"))
    held.savepoint("before")
    changed = orders.where("o_orderkey % 5 = 0").withColumn("o_orderstatus", F.lit("X"))
    added = orders.where("o_orderkey % 7 = 0").withColumn("o_orderkey", -1 - F.col("o_orderkey"))
    held.commit("main", changed.unionByName(added))
    summary = held.undo_summary("before")
    held.undo_to("before")
    now = held.read().select(*orders.columns)
    off = now.exceptAll(orders).unionByName(orders.exceptAll(now))
    return summary.select("op", "n").unionByName(off.agg(F.lit("differs").alias("op"), F.count("*").alias("n")))


# -- streams ---------------------------------------------------------------------


def _as_stream(spark, rows: DataFrame, name: str, order: str, files: int = 4) -> DataFrame:
    """A table as a stream of several files, in time order."""
    path = work_path(spark, name)
    rows.repartitionByRange(files, order).sortWithinPartitions(order).write.parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false")
    return stream.parquet(path)


def stream_time_bucket_rows(spark, folder):
    """Buckets closed by the watermark, one hour behind the newest event.

    The files are written at once and come in one batch, whatever their order, so no
    event is late; a batch keeps a state row for each bucket and event type only.
    """
    events = _events(spark, folder).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    path = work_path(spark, "events")
    events.write.parquet(path)
    stream = spark.readStream.schema(events.schema).parquet(path)
    sink, checkpoint = work_path(spark, "buckets"), work_path(spark, "stream-state")
    aggs = [F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")]
    stream_time_bucket(stream, "ts", "6 hours", aggs, ["event_type"], "1 hour", sink, checkpoint).awaitTermination()
    return spark.read.schema("bucket timestamp, event_type string, n long, total double").parquet(sink)


def stream_index_append(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    empty = FrameIndex(docs.limit(0), "doc_id", "text").write(work_path(spark, "index"), buckets=8)
    stream = _as_stream(spark, docs, "documents", "doc_id", files=3)
    stream_into_index(stream, spark, empty.path, "documents", work_path(spark, "stream-state")).awaitTermination()
    index = StoredIndex.open(spark, empty.path)
    return search(index, Or("the", "la", "und"), limit=100).select(F.col("id").alias("doc_id"), "rank", "score")


def stream_queue(spark, folder):
    log = _queue_log(spark, folder)
    stream = _as_stream(spark, log, "queue-log", "event_ts")
    sink = work_path(spark, "queue-state")
    stream_queue_state(stream, sink, work_path(spark, "stream-state")).awaitTermination()
    return read_queue_state(spark, sink).groupBy("queue", "state").agg(
        F.count("*").alias("n"), F.sum("read_ct").alias("n_reads")
    )


QUERIES = {
    "time_bucket_agg": time_bucket_agg,
    "time_bucket_weeks": time_bucket_weeks,
    "chunk_catalog": chunk_catalog_rows,
    "chunks_on_disk": chunks_on_disk,
    "chunk_range_read": chunk_range_read,
    "partition_plan": partition_plan_rows,
    "version_read": version_read,
    "version_as_of": version_as_of,
    "version_diff": version_diff,
    "version_conflicts": version_conflicts,
    "version_merge": version_merge,
    "version_undo": version_undo,
    "version_cycle": version_cycle,
    "prov_distinct_formula": prov_distinct_formula,
    "prov_join_count": prov_join_count,
    "prov_weighted_count": prov_weighted_count,
    "prov_why": prov_why,
    "prov_probability": prov_probability,
    "prov_join_probability": prov_join_probability,
    "prov_dependent_probability": prov_dependent_probability,
    "prov_expected_sum": prov_expected_sum,
    "prov_dependent_shapley": prov_dependent_shapley,
    "prov_where_join": prov_where_join,
    "prov_shapley": prov_shapley,
    "prov_banzhaf": prov_banzhaf,
    "queue_visible": queue_visible,
    "queue_read": queue_read,
    "queue_archive": queue_archive,
    "json_schema_check": json_check,
    "json_schema_summary": json_summary,
    "json_schema_items": json_items,
    "xml_table": xml_rows,
    "trigram_similarity": trigram_scores,
    "trigram_join": trigram_pairs,
    "trigram_join_parts": trigram_part_pairs,
    "hierarchy_rollup": rollup,
    "unaccent": unaccented,
    "graph_two_hop": graph_two_hop,
    "graph_traverse": graph_traverse,
    "graph_traverse_deep": graph_traverse_deep,
    "path_query": path_query_rows,
    "classify_batch": classify_batch,
    "classify_stats": classify_stats,
    "yes_no": yes_no_scores,
    "row_filter": row_filter_rows,
    "assert_tables": assert_table_results,
    "stream_time_bucket": stream_time_bucket_rows,
    "version_savepoint": version_savepoint,
    "queue_log_range": queue_log_range,
    "time_ordered_ids": time_ordered_ids,
    "hstore_maps": hstore_maps,
    "stream_index_append": stream_index_append,
    "stream_queue": stream_queue,
}

_O = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"
_DONE = "o_orderstatus = 'F'"
_STATES = f"""
o AS (SELECT {_O} FROM orders),
forked AS (SELECT * REPLACE (CASE WHEN {_DONE} AND o_orderpriority = '1-URGENT' THEN '0-NOW' ELSE o_orderpriority END AS o_orderpriority) FROM o),
review AS (SELECT CASE WHEN {_DONE} AND o.o_totalprice > 200000 THEN 'up' WHEN o.o_orderstatus = 'P' AND o.o_orderpriority = '2-HIGH' THEN 'up'
    WHEN o.o_orderstatus = 'P' AND o.o_orderpriority = '5-LOW' THEN 'del' ELSE '' END AS op,
  o_orderkey, o_custkey,
  CASE WHEN {_DONE} AND o_totalprice > 200000 THEN 'R' ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '2-HIGH' THEN o_totalprice + 100 ELSE o_totalprice END AS o_totalprice,
  CASE WHEN {_DONE} AND o_totalprice <= 200000 AND o_orderpriority = '1-URGENT' THEN '0-NOW' ELSE o_orderpriority END AS o_orderpriority FROM o),
main AS (SELECT o_orderkey, o_custkey,
  CASE WHEN {_DONE} AND o_totalprice > 300000 AND o_orderpriority <> '1-URGENT' THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
  o_totalprice,
  CASE WHEN {_DONE} AND o_orderpriority = '1-URGENT' THEN '0-NOW' WHEN o_orderstatus = 'P' AND o_orderpriority = '2-HIGH' THEN '2-NEXT' ELSE o_orderpriority END AS o_orderpriority
  FROM o WHERE NOT (o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'))"""
_SIDES = f"""{_STATES},
sides AS (SELECT f.o_orderkey, f AS f, CASE WHEN m.o_orderkey IS NOT NULL THEN m END AS m, CASE WHEN r.op <> 'del' THEN r END AS r, r.op AS op
  FROM forked f JOIN review r USING (o_orderkey) LEFT JOIN main m USING (o_orderkey) WHERE r.op <> '')"""


def _clash(col: str) -> str:
    return (
        f"(m IS NOT NULL AND r IS NOT NULL AND m.{col} IS DISTINCT FROM f.{col} AND r.{col} IS DISTINCT FROM f.{col} "
        f"AND m.{col} IS DISTINCT FROM r.{col})"
    )


_FIELDS = COLUMNS[1:]
_ANY_CLASH = " OR ".join(_clash(c) for c in _FIELDS)
_CUST = "orders JOIN customer ON c_custkey = o_custkey"
_TOKEN = "substr(sha256('orders' || chr(31) || o_orderkey::VARCHAR), 1, 32)"
_CHANCE = "CASE o_orderstatus WHEN 'F' THEN 1::DOUBLE / 3 WHEN 'O' THEN 2::DOUBLE / 7 ELSE 1::DOUBLE / 7 END"
_QUEUE = f"""
q AS (SELECT event_type AS queue, event_id AS msg_id, props AS message, ts AS sent_at, (props->>'k')::INT AS k, value,
  value > 40 AS was_read, ts + INTERVAL 1 HOUR AS read_at, ts + to_hours(floor(value)::INT) AS vt,
  ts + INTERVAL 2 HOUR AS archived_at FROM events)"""
_NOW = f"TIMESTAMP '{NOW}'"
_VISIBLE = f"""{_QUEUE},
visible AS (SELECT queue, msg_id, message, sent_at, CASE WHEN was_read AND read_at <= {_NOW} THEN 1 ELSE 0 END::BIGINT AS read_ct
  FROM q WHERE sent_at <= {_NOW} AND NOT (k < 20 AND archived_at <= {_NOW}) AND NOT (was_read AND read_at <= {_NOW} AND vt > {_NOW}))"""


def _grams(col: str) -> str:
    return (
        rf"list_distinct(flatten(list_transform(regexp_extract_all(lower({col}), '[\p{{L}}\p{{N}}]+'), "
        "lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
    )


def _similarity(a: str, b: str) -> str:
    return f"round(len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))), 6)"


def _pairs_sql(source: str, col: str, threshold: float) -> str:
    return f"""
WITH v AS (SELECT {col} AS value, count(*) AS n, any_value({_grams(col)}) AS g FROM {source} GROUP BY 1)
SELECT a.value AS left_value, b.value AS right_value, {_similarity('a.g', 'b.g')} AS similarity, a.n AS n_left, b.n AS n_right
FROM v a JOIN v b ON a.value < b.value WHERE {_similarity('a.g', 'b.g')} >= {threshold}"""


_SOURCE, _TARGET = accent_map()
_PLAIN = f"translate(text, '{_SOURCE}', '{_TARGET}')"
for _letter, _pair in LETTER_PAIRS.items():
    _PLAIN = f"replace({_PLAIN}, '{_letter}', '{_pair}')"

_EDGES = """
edges AS (SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders
  UNION SELECT 'o' || l_orderkey, 's' || l_suppkey FROM lineitem)"""


def _walk_sql(start: str, edges: str, depth: int) -> str:
    """Breadth first by levels; each level drops what was seen before."""
    ctes = [f"l0 AS ({start})"]
    for n in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT id FROM l{i}" for i in range(n))
        ctes.append(
            f"l{n} AS (SELECT DISTINCT dst AS id FROM l{n - 1} JOIN {edges} ON src = id WHERE dst NOT IN ({seen}))"
        )
    out = " UNION ALL ".join(f"SELECT id, {n}::INT AS depth FROM l{n}" for n in range(depth + 1))
    return ", ".join(ctes) + " " + out


_RANKED = """
SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank, score FROM o ORDER BY score DESC, doc_id LIMIT 100"""

def _bayes_sql(yes: str, no: str) -> str:
    """Naive Bayes over ``given`` (text, label) for the texts of ``asked`` (doc_id, text)."""
    return f"""
gtoks AS (SELECT label, unnest({TOKENS}) AS term FROM given),
ns AS (SELECT term, count(*) FILTER (label = '{yes}') AS n1, count(*) FILTER (label = '{no}') AS n0 FROM gtoks GROUP BY 1),
below AS (SELECT sum(n1) + count(*) AS b1, sum(n0) + count(*) AS b0 FROM ns),
prior AS (SELECT ln(count(*) FILTER (label = '{yes}') / count(label)) AS l1, ln(count(*) FILTER (label = '{no}') / count(label)) AS l0 FROM given),
terms AS (SELECT doc_id, unnest({TOKENS}) AS term FROM asked),
sums AS (SELECT doc_id, sum(ln((n1 + 1) / b1)) AS s1, sum(ln((n0 + 1) / b0)) AS s0 FROM terms JOIN ns USING (term), below GROUP BY 1),
chances AS (SELECT doc_id, len({TOKENS}) AS size, 1 / (1 + exp(l0 + coalesce(s0, 0) - l1 - coalesce(s1, 0))) AS p1,
  1 / (1 + exp(l1 + coalesce(s1, 0) - l0 - coalesce(s0, 0))) AS p0 FROM asked LEFT JOIN sums USING (doc_id), prior)"""


_BAYES = """asked AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL),
given AS (SELECT text, toxic::VARCHAR AS label FROM documents JOIN labels USING (doc_id))"""
_TOXIC = _bayes_sql("1", "0")


def _token_sql(source: str, key: str) -> str:
    return f"substr(sha256('{source}' || chr(31) || {key}), 1, 32)"


ORACLES = {
    "time_bucket_agg": """
SELECT time_bucket(INTERVAL '15 minutes', ts) AS bucket, event_type, count(*) AS n, round(sum(value), 6) AS total, max(value) AS high
FROM events GROUP BY 1, 2""",
    "time_bucket_weeks": "SELECT time_bucket(INTERVAL '7 days', ts) AS bucket, count(*) AS n, min(ts) AS first_ts FROM events GROUP BY 1",
    "chunk_catalog": """
SELECT time_bucket(INTERVAL '6 hours', ts) AS chunk, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_rows FROM events GROUP BY 1""",
    "chunks_on_disk": """
SELECT time_bucket(INTERVAL '6 hours', ts) AS chunk, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_rows FROM events GROUP BY 1""",
    "chunk_range_read": """
SELECT event_id, ts, value FROM events WHERE ts >= TIMESTAMP '2024-01-10 03:00:00' AND ts < TIMESTAMP '2024-01-12 09:30:00'""",
    "partition_plan": """
WITH c AS (SELECT l_orderkey // 1000 AS part, count(*) AS n FROM lineitem GROUP BY 1),
r AS (SELECT unnest(range((SELECT min(part) FROM c), (SELECT max(part) FROM c) + 1)) AS part)
SELECT part, part * 1000 AS range_start, (part + 1) * 1000 AS range_end, coalesce(n, 0) AS n_rows FROM r LEFT JOIN c USING (part)""",
    "version_read": f"WITH {_STATES} SELECT {_O} FROM review WHERE op <> 'del'",
    "version_as_of": f"WITH {_STATES} SELECT {_O} FROM forked",
    "version_diff": f"WITH {_SIDES} " + " UNION ALL ".join(
        f"SELECT o_orderkey, CASE WHEN r IS NULL THEN 'delete' ELSE 'update' END AS op, '{c}' AS col, f.{c}::VARCHAR AS old, r.{c}::VARCHAR AS new "
        f"FROM sides WHERE r IS NULL OR f.{c} IS DISTINCT FROM r.{c}" for c in _FIELDS
    ),
    "version_conflicts": f"WITH {_SIDES} " + " UNION ALL ".join(
        f"SELECT o_orderkey, '{c}' AS col, f.{c}::VARCHAR AS base, m.{c}::VARCHAR AS ours, r.{c}::VARCHAR AS theirs FROM sides WHERE {_clash(c)}"
        for c in _FIELDS
    ),
    "version_merge": f"WITH {_SIDES} SELECT CASE WHEN r IS NULL THEN 'delete' ELSE 'upsert' END AS op, o_orderkey, " + ", ".join(
        f"CASE WHEN r.{c} IS DISTINCT FROM f.{c} THEN r.{c} ELSE m.{c} END AS {c}" for c in _FIELDS
    ) + f" FROM sides WHERE NOT ({_ANY_CLASH}) AND m IS NOT NULL",
    "version_undo": f"WITH {_STATES} SELECT 'upsert' AS op, * FROM (SELECT {_O} FROM forked EXCEPT SELECT {_O} FROM main)",
    "prov_distinct_formula": """
SELECT c_nationkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_name) AS place,
  c_name AS term FROM customer""",
    "version_cycle": """
SELECT o_orderkey, state, o_totalprice * CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE 1 END AS o_totalprice,
  CASE WHEN o_orderkey % 10 = 0 AND state = 'merged' THEN 'Y' WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus
FROM orders, (VALUES ('merged'), ('undone')) s(state)""",
    "prov_dependent_probability": """
SELECT l_orderkey, round(0.5::DOUBLE * (1 - pow(0.75::DOUBLE, count(DISTINCT l_suppkey))), 6) AS probability
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1""",
    "prov_expected_sum": """
WITH p AS (SELECT o_custkey, o_orderkey, o_totalprice, 0.5::DOUBLE * (1 - pow(0.75::DOUBLE, count(DISTINCT l_suppkey))) AS p
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL)
SELECT o_custkey, round(sum(round(p, 6)), 6) AS expected_count, round(sum(round(p, 6) * o_totalprice::DOUBLE), 2) AS expected_sum FROM p GROUP BY 1""",
    "prov_dependent_shapley": f"""
WITH pairs AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  JOIN supplier ON s_suppkey = l_suppkey),
n AS (SELECT l_orderkey, count(*) AS n FROM pairs GROUP BY 1)
SELECT l_orderkey, {_token_sql('orders', 'l_orderkey')} AS token, round(n / (n + 1), 6) AS shapley FROM n
UNION ALL SELECT l_orderkey, {_token_sql('supplier', 'l_suppkey')}, round(1 / (n * (n + 1)), 6)
FROM pairs JOIN n USING (l_orderkey)""",
    "prov_where_join": f"""
WITH pairs AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  JOIN supplier ON s_suppkey = l_suppkey)
SELECT l_suppkey, l_orderkey, 'l_orderkey' AS out_column, 'orders' AS "table", 'l_orderkey' AS "column",
  {_token_sql('orders', 'l_orderkey')} AS token FROM pairs
UNION ALL SELECT l_suppkey, l_orderkey, 'l_suppkey', 'supplier', 'l_suppkey', {_token_sql('supplier', 'l_suppkey')}
FROM pairs""",
    "prov_join_count": f"SELECT c_nationkey, o_orderstatus, count(*) AS count FROM {_CUST} GROUP BY 1, 2",
    "prov_weighted_count": f"SELECT c_nationkey, sum(CASE WHEN o_orderstatus = 'F' THEN 3 ELSE 1 END)::BIGINT AS count FROM {_CUST} GROUP BY 1",
    "prov_why": f"SELECT c_nationkey, o_orderstatus, count(*) AS n_witnesses, 2 * count(*) AS n_tokens FROM {_CUST} GROUP BY 1, 2",
    "prov_probability": f"SELECT o_custkey, round(1 - exp(sum(ln(1 - {_CHANCE}))), 6) AS probability FROM orders GROUP BY 1",
    "prov_join_probability": f"""
SELECT DISTINCT l_orderkey, l_suppkey, round(0.9::DOUBLE * {_CHANCE}, 6) AS probability
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey""",
    "prov_shapley": f"""
SELECT o_custkey, {_TOKEN} AS token, round(1::DOUBLE / count(*) OVER (PARTITION BY o_custkey), 6) AS shapley FROM orders""",
    "prov_banzhaf": f"""
SELECT o_custkey, {_TOKEN} AS token, round(pow(2::DOUBLE, 1 - count(*) OVER (PARTITION BY o_custkey)), 6) AS banzhaf FROM orders""",
    "queue_visible": f"WITH {_VISIBLE} SELECT * FROM visible",
    "queue_read": f"""
WITH {_VISIBLE} SELECT queue, place::INT AS place, msg_id, message FROM
(SELECT *, row_number() OVER (PARTITION BY queue ORDER BY msg_id) AS place FROM visible) WHERE place <= 10""",
    "queue_archive": f"WITH {_QUEUE} SELECT queue, msg_id, message, archived_at FROM q WHERE k < 20",
    "json_schema_check": """
SELECT event_id, k BETWEEN 10 AND 90 AS valid, CASE WHEN k < 10 THEN 'minimum' WHEN k > 90 THEN 'maximum' ELSE '' END AS rules
FROM (SELECT event_id, (props->>'k')::INT AS k FROM events)""",
    "json_schema_summary": """
SELECT rule, '$.k' AS path, count(*) AS n_rows FROM (SELECT CASE WHEN k < 10 THEN 'minimum' WHEN k > 90 THEN 'maximum' END AS rule
FROM (SELECT (props->>'k')::INT AS k FROM events)) WHERE rule IS NOT NULL GROUP BY 1""",
    "json_schema_items": """
WITH l AS (SELECT l_orderkey, l_quantity::DOUBLE + if(l_linenumber = 3, 0.5, 0) AS q,
  if(l_linenumber <> 5, l_returnflag, NULL) AS flag, least(l_partkey, l_suppkey) AS low FROM lineitem),
v AS (SELECT l_orderkey, concat_ws(',', if(bool_or(flag IS NULL), 'required $.lines[].flag', NULL),
  if(bool_or(q <> floor(q)), 'type $.lines[].q', NULL), if(bool_or(q > 45), 'maximum $.lines[].q', NULL),
  if(bool_or(flag NOT IN ('N', 'A')), 'enum $.lines[].flag', NULL), if(bool_or(low < 20), 'minimum $.lines[].parts[]', NULL)) AS rules
  FROM l GROUP BY 1)
SELECT l_orderkey, rules = '' AS valid, rules FROM v""",
    "xml_table": """
SELECT c_custkey, c_mktsegment AS seg, c_name AS name FROM customer
UNION ALL SELECT c_custkey, 'n', c_nationkey::VARCHAR FROM customer""",
    "trigram_similarity": f"""
SELECT p_partkey, {_similarity('a', 'b')} AS similarity FROM (SELECT p_partkey, {_grams('p_name')} AS a,
  {_grams("(p_type || ' ' || p_name || ' ' || p_brand)")} AS b FROM part)""",
    "trigram_join": _pairs_sql("customer", "c_name", 0.75),
    "trigram_join_parts": _pairs_sql("part", "p_name", 0.3),
    "hierarchy_rollup": """
WITH p AS (SELECT replace(r_name, ' ', '_') AS r, n_name AS n, c_mktsegment AS c, c_acctbal AS x
  FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)
SELECT r AS path, 1::INT AS depth, count(*) AS n, round(sum(x), 2) AS balance FROM p GROUP BY 1
UNION ALL SELECT r || '.' || n, 2, count(*), round(sum(x), 2) FROM p GROUP BY 1
UNION ALL SELECT r || '.' || n || '.' || c, 3, count(*), round(sum(x), 2) FROM p GROUP BY 1""",
    "unaccent": f"SELECT doc_id, {_PLAIN} AS plain FROM documents",
    "graph_two_hop": """
SELECT DISTINCT 'c' || c_custkey AS v0, 'o' || o_orderkey AS v1, 's' || s_suppkey AS v2
FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey
WHERE c_nationkey = 3 AND s_nationkey = 3""",
    "graph_traverse": f"WITH {_EDGES}, " + _walk_sql("SELECT 'c' || c_custkey AS id FROM customer WHERE c_nationkey = 7", "edges", 3),
    "graph_traverse_deep": f"WITH {_EDGES}, u AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), "
    + _walk_sql("SELECT 's' || s_suppkey AS id FROM supplier WHERE s_nationkey = 7", "u", 5),
    "path_query": "SELECT event_id, ts, user_id, value FROM events WHERE event_type = 'error' ORDER BY ts DESC LIMIT 25",
    "classify_batch": f"""
WITH {_BAYES}, {_TOXIC} SELECT doc_id, CASE WHEN p1 > p0 THEN '1' ELSE '0' END AS choice, round(greatest(p0, p1), 6) AS confidence,
  'naive-bayes' AS model, size::BIGINT AS input_tokens, 1::BIGINT AS output_tokens FROM chances
UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, NULL FROM documents WHERE text IS NULL""",
    "classify_stats": f"""
WITH {_BAYES}, {_TOXIC} SELECT 'naive-bayes' AS model, count(*) AS n_rows, count(*) AS n_answered,
  sum(size)::BIGINT AS input_tokens, count(*) AS output_tokens FROM chances HAVING count(*) > 0
UNION ALL SELECT NULL, count(*), 0, NULL, NULL FROM documents WHERE text IS NULL HAVING count(*) > 0""",
    "yes_no": f"""
WITH {_BAYES}, {_TOXIC} SELECT doc_id, round(p1, 6) AS number FROM chances
UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL""",
    "row_filter": f"""
WITH asked AS (SELECT DISTINCT row_number() OVER (ORDER BY lang, source) AS doc_id, text, lang, source, n FROM (
    SELECT lang, source, count(*) AS n, concat('{{', concat_ws(',', '"lang":"' || lang || '"', '"source":"' || source || '"'), '}}') AS text
    FROM documents GROUP BY 1, 2)),
given AS (SELECT a.text, (d.n_chars > 1000)::VARCHAR AS label FROM documents d JOIN asked a
  ON a.lang IS NOT DISTINCT FROM d.lang AND a.source IS NOT DISTINCT FROM d.source),
{_bayes_sql("true", "false")}
SELECT lang, source, n FROM chances JOIN asked USING (doc_id) WHERE p1 >= 0.7""",
    "assert_tables": """
WITH f AS (SELECT count(*) FILTER (o_orderstatus = 'F') AS n FROM orders),
q AS (SELECT count(*) FILTER (l_quantity <= 0) AS z, count(*) FILTER (l_quantity <= 10) AS s FROM lineitem),
k AS (SELECT count(*) AS n FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1))
SELECT true AS ok, 1::INT AS n, 'counts agree' AS description, NULL::VARCHAR AS detail
UNION ALL SELECT n = 0, 2, 'nothing is finished', CASE WHEN n > 0 THEN 'extra rows: ' || n || ' missing rows: 0' END FROM f
UNION ALL SELECT count(*) = 0, 3, 'every order has a customer', CASE WHEN count(*) > 0 THEN 'rows: ' || count(*) END
  FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT z = 0, 4, 'quantities are positive', CASE WHEN z > 0 THEN 'broken rows: ' || z END FROM q
UNION ALL SELECT s = 0, 5, 'quantities are large', CASE WHEN s > 0 THEN 'broken rows: ' || s END FROM q
UNION ALL SELECT true, 6, 'order keys are unique', NULL
UNION ALL SELECT n = 0, 7, 'one order per customer', CASE WHEN n > 0 THEN 'repeated keys: ' || n END FROM k
UNION ALL SELECT false, 8, 'orders have their columns', 'missing: o_nothing'""",
    "version_savepoint": """
SELECT 'upsert' AS op, count(*) AS n FROM orders WHERE o_orderkey % 5 = 0
UNION ALL SELECT 'delete', count(*) FROM orders WHERE o_orderkey % 7 = 0
UNION ALL SELECT 'differs', 0""",
    "queue_log_range": f"""
WITH {_QUEUE}, r AS (SELECT * FROM q WHERE msg_id BETWEEN 100 AND 299)
SELECT queue, msg_id, 'send' AS op, sent_at AS event_ts FROM r
UNION ALL SELECT queue, msg_id, 'read', read_at FROM r WHERE was_read
UNION ALL SELECT queue, msg_id, 'archive', archived_at FROM r WHERE k < 20""",
    "time_ordered_ids": """
WITH e AS (SELECT event_id, lpad(to_hex(epoch_us(ts) // 1000), 12, '0') AS t, sha256(event_id::VARCHAR) AS b FROM events)
SELECT event_id, lower(t[1:8]) || '-' || lower(t[9:12]) || '-7' || b[1:3] || '-?' || b[4:6] || '-' || b[7:18] AS stem,
  true AS variant_ok FROM e""",
    "hstore_maps": """
SELECT doc_id, doc_id::VARCHAR AS id, source || ', "=>\\' AS source, lang, 3::BIGINT AS n_keys FROM documents""",
    "stream_time_bucket": """
SELECT time_bucket(INTERVAL '6 hours', ts) AS bucket, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2
HAVING time_bucket(INTERVAL '6 hours', any_value(ts)) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
    "stream_index_append": f"""
WITH {bm25_sql()}, o AS (SELECT id AS doc_id, round(sum(s), 6) AS score FROM impact WHERE term IN ('the', 'la', 'und') GROUP BY 1)
{_RANKED}""",
    "stream_queue": f"""
WITH {_QUEUE} SELECT queue, CASE WHEN k < 20 THEN 'archived' ELSE 'live' END AS state, count(*) AS n,
  sum(CASE WHEN was_read THEN 1 ELSE 0 END)::BIGINT AS n_reads FROM q GROUP BY 1, 2""",
}
