"""Registered queries over the test tables, each beside the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom import tables
from noteloom.functions import intent as intents
from noteloom.functions import scoring, text, timerange
from noteloom.operators import chunking, examples, filters, graph, mutations, questions, rounds, search, sections, stats, structure
from noteloom.operators import notes as note_ops
from noteloom.plans import base as bases
from noteloom.plans import index
from noteloom.plans.bridge import EDGES, LINKS, NEAR, NOTE_TAGS, NOTES, PASSAGES, TURNS, links, notes, passages, table, turns
from noteloom.plans.expr import Compiler, parse, schema_resolver
from noteloom.streaming import feed, run
from noteloom.streaming.debounce import debounced

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: The moment that relative dates refer to.
NOW = datetime(2024, 1, 20, 12, 0, tzinfo=timezone.utc)
QUERY_TEXT = "the src3 ention about nature"


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return add


# --- notes, tags, links -------------------------------------------------------------------------


@query(r"""SELECT doc_id, coalesce(regexp_extract_all(text, '#([\pL\pN_][\pL\pN_/-]+)', 1), []) AS tags, coalesce(regexp_extract_all(text, '\[\[([^\]]+)\]\]', 1), []) AS links,
  regexp_replace(text, '^\s+|\s+$', '', 'g') AS body FROM documents""")
def note_parse(spark, d):
    return table(spark, d, "documents").select("doc_id", text.body_tags(F.col("text")).alias("tags"), text.links(F.col("text")).alias("links"), text.trimmed(F.col("text")).alias("body"))


@query(r"SELECT page_id, list_filter(list_transform(string_split(coalesce(regexp_extract(url, '\?([^#]*)', 1), ''), '&'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM pages")
def parse_delimited(spark, d):
    q = F.regexp_extract(F.coalesce("url", F.lit("")), r"\?([^#]*)", 1)
    return table(spark, d, "pages").select("page_id", text.parse_delimited(F.replace(q, F.lit("&"), F.lit(","))).alias("parts"))


@query("""SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...[truncated]' ELSE text END AS cut, lang || ',' || source AS joined,
  CASE WHEN n_chars = 0 THEN NULL ELSE round(1000.0 / n_chars, 9) END AS ratio FROM documents""")
def sanitize(spark, d):
    ratio = mutations.sanitized_number(F.try_divide(F.lit(1000.0), F.col("n_chars").cast("double")))
    return table(spark, d, "documents").select("doc_id", mutations.sanitized_string(F.col("text"), 200).alias("cut"), mutations.sanitized_list(F.array("lang", "source")).alias("joined"), F.round(ratio, 9).alias("ratio"))


@query(f"WITH {NOTES} SELECT note_id, title, text FROM notes WHERE note_id = 'src3/doc-3.md'")
def read_note(spark, d):
    return note_ops.read_note(notes(spark, d), "src3/doc-3.md").select("note_id", "title", "text")


@query(f"WITH {PASSAGES} SELECT chunk_id, note_id, chunk_type FROM chunks WHERE chunk_id IN (SELECT 'vec-' || part FROM (SELECT DISTINCT l_partkey AS part FROM lineitem WHERE l_quantity > 49))")
def fetch_chunks(spark, d):
    ids = table(spark, d, "lineitem").filter("l_quantity > 49").select(F.concat(F.lit("vec-"), F.col("l_partkey").cast("string")).alias("chunk_id"))
    return search.fetch_chunks(ids, passages(spark, d)).select("chunk_id", "note_id", "chunk_type")


@query("SELECT doc_id, lang, source FROM documents WHERE lang = 'en' AND contains(source, '1') AND lang <> 'de' AND n_chars::VARCHAR <> '0'")
def where_match(spark, d):
    df = table(spark, d, "documents")
    return df.filter(filters.where_match(df, {"lang": {"$eq": "en", "$ne": "de"}, "source": {"$contains": 1}, "n_chars": {"$ne": 0}})).select("doc_id", "lang", "source")


@query("SELECT doc_id, source || '/' || lang || '/' || doc_id AS path FROM documents WHERE source IN ('src1', 'src2')")
def folder_filter(spark, d):
    p = table(spark, d, "documents").select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"))
    return p.filter(filters.in_folders(F.col("path"), ["src1", "src2/"]))


@query("""WITH keys AS (SELECT lower(p_name) AS key, min(p_partkey) AS dst FROM part GROUP BY 1)
  SELECT p_partkey AS src, 0 AS ord, dst FROM part JOIN keys ON key = lower(p_name)""")
def resolve_links(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("note_id"), F.col("p_name").alias("title"), F.col("p_name").alias("stem"), F.array(F.upper("p_name")).alias("links"))
    return note_ops.resolve_links(part).select("src", F.col("ord").cast("int").alias("ord"), "dst")


@query(f"WITH {LINKS} SELECT dst AS note_id, list_sort(list(DISTINCT src)) AS backlinks, count(DISTINCT src) AS n FROM links GROUP BY dst")
def backlinks(spark, d):
    return note_ops.backlinks(links(spark, d))


@query(f"WITH {LINKS} SELECT src, dst FROM links")
def note_edges(spark, d):
    return links(spark, d)


@query(f"WITH {NOTE_TAGS} SELECT o.note_id, count(DISTINCT o.tag) AS shared FROM note_tags o JOIN note_tags m ON m.tag = o.tag AND m.note_id = 'src3/doc-3.md' WHERE o.note_id <> 'src3/doc-3.md' GROUP BY 1")
def tag_neighbors(spark, d):
    return note_ops.tag_neighbors(note_ops.note_tags(notes(spark, d)), F.lit("src3/doc-3.md"))


@query(f"WITH {NOTES} SELECT note_id, title FROM notes WHERE list_contains(tags, 'lang/de')")
def notes_by_tag(spark, d):
    return note_ops.notes_by_tag(notes(spark, d), "lang/de")


@query(f"WITH {NOTE_TAGS} SELECT tag, count(*) AS n FROM note_tags GROUP BY tag")
def all_tags(spark, d):
    return note_ops.tag_counts(note_ops.note_tags(notes(spark, d)))


@query(f"""WITH {NOTE_TAGS}, p AS (SELECT string_split(tag, '/') AS parts FROM note_tags), q AS (SELECT parts, unnest(range(1, len(parts) + 1)) AS level FROM p)
  SELECT array_to_string(parts[1:level], '/') AS path, level::INT AS level, count(*) AS n FROM q GROUP BY 1, 2""")
def tag_hierarchy(spark, d):
    return note_ops.tag_hierarchy(note_ops.note_tags(notes(spark, d)))


@query(f"""WITH {NOTE_TAGS} SELECT (SELECT count(DISTINCT note_id) FROM notes) AS total_notes, (SELECT sum(len(tags))::BIGINT FROM notes) AS total_links,
  (SELECT count(DISTINCT tag) FROM note_tags) AS total_tags, (SELECT count(*) FROM conversations) AS total_chunks""", name="stats")
def collection_stats(spark, d):
    n = notes(spark, d).withColumn("links", F.col("tags"))
    return note_ops.collection_stats(n, turns(spark, d))


@query("SELECT 'conv-' || conv_id AS note_id, 'conversation ' || conv_id AS title, count(*) AS chunk_count FROM conversations GROUP BY conv_id")
def all_notes(spark, d):
    c = turns(spark, d)
    n = c.select("note_id").distinct().withColumn("title", F.replace("note_id", F.lit("conv-"), F.lit("conversation ")))
    return note_ops.all_notes(n, c)


@query(f"WITH {NOTES} SELECT note_id, CASE WHEN title = 'doc-7' THEN 0 ELSE 2 END::INT AS rank FROM notes WHERE title = 'doc-7' OR contains(note_id, 'doc-7') ORDER BY rank, note_id LIMIT 1")
def resolve_note(spark, d):
    return note_ops.resolve_note(notes(spark, d), "doc-7")


@query(f"""WITH {LINKS}, b AS (SELECT src AS note_id, 1 AS o, 0 AS i FROM links UNION ALL SELECT dst, 0, 1 FROM links)
  SELECT note_id, sum(o)::BIGINT AS link_count, sum(i)::BIGINT AS backlink_count, (sum(o) + sum(i))::BIGINT AS connectivity FROM b GROUP BY note_id""")
def graph_metrics(spark, d):
    return note_ops.graph_metrics(links(spark, d))


@query(f"""WITH {LINKS}, b AS (SELECT src AS note_id, 1 AS o, 0 AS i FROM links UNION ALL SELECT dst, 0, 1 FROM links)
  SELECT note_id, sum(o)::BIGINT AS link_count, sum(i)::BIGINT AS backlink_count, (sum(o) + sum(i))::BIGINT AS connectivity FROM b GROUP BY note_id ORDER BY connectivity DESC, note_id LIMIT 10""")
def ext_degree(spark, d):
    return note_ops.most_linked(links(spark, d), 10)


@query("SELECT 'p' || p_partkey AS note_id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)")
def ext_orphans(spark, d):
    return note_ops.orphans(table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("note_id")), links(spark, d))


@query("SELECT p_name AS title FROM part WHERE lower(p_name) IN (SELECT lower(p_name) FROM part WHERE p_size > 49)")
def title_exists(spark, d):
    p = table(spark, d, "part")
    return note_ops.exists_in(p.select(F.col("p_name").alias("title")), p.filter("p_size > 49").select(F.upper("p_name").alias("title")))


# --- filters ------------------------------------------------------------------------------------

for _op, _col, _value, _sql in (
    ("eq", "p_brand", "Brand#2", "p_brand = 'Brand#2'"),
    ("neq", "p_brand", "Brand#2", "p_brand <> 'Brand#2'"),
    ("gt", "p_size", 25, "p_size > 25"),
    ("gte", "p_size", 25, "p_size >= 25"),
    ("lt", "p_retailprice", 950.0, "p_retailprice < 950"),
    ("lte", "p_retailprice", 950.0, "p_retailprice <= 950"),
    ("in", "p_type", ["ECONOMY", "SMALL"], "p_type IN ('ECONOMY', 'SMALL')"),
    ("nin", "p_type", ["ECONOMY", "SMALL"], "p_type NOT IN ('ECONOMY', 'SMALL')"),
    ("contains", "p_name", "RING", "contains(lower(p_name), 'ring')"),
    ("ncontains", "p_name", "RING", "NOT coalesce(contains(lower(p_name), 'ring'), false)"),
    ("exists", "p_name", None, "p_name IS NOT NULL"),
    ("nexists", "p_name", None, "p_name IS NULL"),
    ("regex", "p_name", "^(red|blue) .*t$", "regexp_matches(p_name, '^(red|blue) .*t$')"),
):

    @query(f"SELECT p_partkey, p_name FROM part WHERE {_sql}", name=f"filter_{_op}")
    def _filter(spark, d, op=_op, col=_col, value=_value):
        return table(spark, d, "part").filter(filters.condition(F.col(col), op, value)).select("p_partkey", "p_name")


# --- views and expressions ----------------------------------------------------------------------

READING = {
    "id": "orders-base", "name": "Orders", "version": 1, "source": {"folders": ["1-URGENT", "2-HIGH", "5-LOW"], "includeSubfolders": True, "filters": [{"property": "o_totalprice", "op": "gt", "value": 100000}, {"property": "o_orderstatus", "op": "in", "value": ["O", "F"]}]},
    "computed": [
        {"id": "is-large", "expr": "price-k > 300", "type": "boolean"},
        {"id": "price-k", "expr": "clamp(o_totalprice / 1000, 0, 400)", "type": "number"},
        {"id": "label", "expr": "concat(upper(c_mktsegment), '-', lower(o_orderstatus))", "type": "string"},
        {"id": "age", "expr": "daysSince(o_orderdate)", "type": "number"},
    ],
    "views": [
        {"id": "main", "name": "Main", "type": "table", "columns": [{"id": "key", "header": "Key", "source": "o_orderkey"}, {"id": "kilo", "header": "Kilo", "source": "@price-k", "format": "progress", "min": 0, "max": 400}, {"id": "large", "header": "Large", "source": "@is-large"}, {"id": "label-text", "header": "Label", "source": "@label"}, {"id": "days", "header": "Days", "source": "@age"}],
         "sort": [{"by": "kilo", "dir": "desc"}, {"by": "o_orderkey"}], "group": {"by": "o_orderstatus", "order": ["O", "F"]}, "pageSize": 50},
        {"id": "cards", "name": "Cards", "type": "card", "card": {"title": "o_orderkey", "subtitle": "@label", "badges": ["o_orderstatus", "c_mktsegment"], "footer": "missing"}, "sort": [{"by": "o_orderdate", "dir": "desc", "nulls": "first"}]},
    ],
}
_ORDERS = """o AS (SELECT *, least(greatest(o_totalprice / 1000, 0), 400) AS kilo, upper(c_mktsegment) || '-' || lower(o_orderstatus) AS label
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000 AND o_orderstatus IN ('O', 'F') AND o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW'))"""
_TABLE = "SELECT o_orderkey AS key, kilo, kilo > 300 AS large, label AS \"label-text\", date_diff('day', o_orderdate::DATE, DATE '2024-01-20')::DOUBLE AS days FROM o"


def _plan(spark, d) -> bases.Plan:
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return bases.Plan(bases.validate(READING), o.withColumn("path", F.concat("o_orderpriority", F.lit("/"), F.col("o_orderkey").cast("string"))), NOW, "path")


@query(f"WITH {_ORDERS} {_TABLE}")
def base_table(spark, d):
    return _plan(spark, d).table("main", "o_orderkey")


@query(f"WITH {_ORDERS} {_TABLE} ORDER BY kilo DESC, o_orderkey LIMIT 25")
def base_query(spark, d):
    return _plan(spark, d).table("main", "o_orderkey", limit=25)


@query(f"WITH {_ORDERS} {_TABLE} ORDER BY kilo DESC, o_orderkey LIMIT 50 OFFSET 50")
def base_page(spark, d):
    return _plan(spark, d).table("main", "o_orderkey", page=2)


@query(f"WITH {_ORDERS} SELECT o_orderkey::VARCHAR AS title, label AS subtitle, NULL::VARCHAR AS image, [o_orderstatus, c_mktsegment] AS badges, NULL::VARCHAR AS footer FROM o")
def base_card(spark, d):
    return _plan(spark, d).cards("cards", "o_orderkey")


@query(f"WITH {_ORDERS}, g AS (SELECT o_orderstatus AS \"group\", count(*) AS n FROM o GROUP BY 1) SELECT \"group\", n, row_number() OVER (ORDER BY CASE \"group\" WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 3 END, \"group\")::INT AS place FROM g")
def base_group(spark, d):
    return _plan(spark, d).groups("main")


@query(f"""WITH {_ORDERS}, g AS (SELECT o_orderstatus AS s, count(*) AS n, row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 3 END, o_orderstatus)::INT AS place FROM o GROUP BY 1)
  SELECT o_orderstatus AS "group", place, n, o_orderkey AS key, kilo, kilo > 300 AS large, label AS "label-text", date_diff('day', o_orderdate::DATE, DATE '2024-01-20')::DOUBLE AS days FROM o JOIN g ON s = o_orderstatus""")
def base_grouped(spark, d):
    """The rows of the view under their groups."""
    return _plan(spark, d).grouped("main", "o_orderkey")


@query("SELECT event_id, row_number() OVER (ORDER BY event_type ASC NULLS LAST, value DESC NULLS FIRST, event_id) AS place FROM events")
def base_sort(spark, d):
    from pyspark.sql import Window

    e = table(spark, d, "events")
    view = bases.View("v", "v", "table", [{"id": "kind", "header": "k", "source": "event_type"}], {}, None, [{"by": "kind"}, {"by": "value", "dir": "desc", "nulls": "first"}])
    plan = bases.Plan(bases.validate(READING | {"computed": [], "source": {"folders": ["/"]}, "views": [{"id": "v", "name": "v", "type": "card"}]}), e, NOW)
    # a total order over all rows is the answer here; sorted partitions number themselves after their sizes are known
    ordered = e.orderBy(*plan.keys(view), "event_id").select("event_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("mark"))
    sizes = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    return ordered.join(F.broadcast(before), "part").select("event_id", (F.col("before") + F.col("mark").bitwiseAND((1 << 33) - 1) + 1).alias("place"))


@query(f"WITH {_ORDERS} SELECT o_orderkey, kilo > 300 AS is_large, kilo AS price_k, label FROM o")
def base_computed(spark, d):
    return _plan(spark, d).rows.select("o_orderkey", F.col("`@is-large`").alias("is_large"), F.col("`@price-k`").alias("price_k"), F.col("`@label`").alias("label"))


@query("SELECT p_partkey FROM part WHERE (p_size > 40 OR contains(p_name, 'ring')) AND NOT (p_type = 'SMALL')")
def base_filter_tree(spark, d):
    p = table(spark, d, "part")
    tree = {"and": [{"or": ["p_size > 40", 'p_name.contains("ring")']}, {"not": ['p_type == "SMALL"']}]}
    return p.filter(bases.filter_tree(tree, Compiler(schema_resolver(p.schema), NOW))).select("p_partkey")


@query("SELECT p_partkey, p_name FROM part WHERE (p_type = 'SMALL' OR p_type = 'ECONOMY') AND p_size >= 10 AND NOT contains(p_name, 'red')")
def base_public_filters(spark, d):
    p = table(spark, d, "part")
    made = bases.public_definition("Small parts", [{"property": "p_type", "op": "in", "value": ["SMALL", "ECONOMY"]}, {"property": "p_size", "op": "gte", "value": 10}, {"property": "p_name", "op": "ncontains", "value": "red"}])
    return p.filter(bases.filter_tree(made["filters"], Compiler(schema_resolver(p.schema), NOW))).select("p_partkey", "p_name")


@query(f"WITH {NOTES} SELECT title, note_id AS path, tags FROM notes WHERE note_id IN ('src1/doc-1.md', 'src2/doc-2.md')")
def base_from_graph(spark, d):
    return bases.Plan(bases.validate(bases.from_notes("Picked", ["src1/doc-1.md", "src2/doc-2.md"])), notes(spark, d), NOW).table()


for _name, _expr, _sql in (
    ("expr_arith", "p_size * 2 + 10 - 4 - 3", "(p_size * 2 + 10 - 4 - 3)::DOUBLE"),
    ("expr_divide", "p_retailprice / (p_size - 5)", "CASE WHEN p_size = 5 THEN NULL ELSE p_retailprice / (p_size - 5) END"),
    ("expr_mod", "(5 - p_size) % 3", "(5 - p_size) - floor((5 - p_size) / 3.0) * 3.0"),
    ("expr_compare", "p_size >= 25", "p_size >= 25"),
    ("expr_cross_type", "p_size == 'x' || p_name != 5", "p_name IS NOT NULL OR p_name IS NULL"),
    ("expr_logic", "!p_size && p_name || p_size > 30 && p_retailprice < 950", "(p_size = 0 AND p_name <> '') OR (p_size > 30 AND p_retailprice < 950)"),
    ("expr_ternary", "p_size > 30 ? 'big' : p_size > 10 ? 'mid' : 'small'", "CASE WHEN p_size > 30 THEN 'big' WHEN p_size > 10 THEN 'mid' ELSE 'small' END"),
    ("expr_string", "concat(upper(p_name), '|', trim(concat('  ', p_type, ' ')), '|', len(p_brand))", "upper(p_name) || '|' || p_type || '|' || length(p_brand)"),
    ("expr_regex", "regexMatch(p_name, 'r.*g$') && contains(p_brand, '#1')", "regexp_matches(p_name, 'r.*g$') AND contains(p_brand, '#1')"),
    ("expr_coalesce", "coalesce(missing, p_type, 'none')", "coalesce(p_type, 'none')"),
    ("expr_clamp", "clamp(p_size, 10, 20)", "least(greatest(p_size, 10), 20)::DOUBLE"),
    ("expr_date", "concat(date('%Y/%m', '2023-05-06'), ' ', daysSince('2024-01-10'))", "'2023/05 10'"),
):

    @query(f"SELECT p_partkey, {_sql} AS result FROM part", name=_name)
    def _evaluate(spark, d, expr=_expr):
        p = table(spark, d, "part")
        return p.select("p_partkey", Compiler(schema_resolver(p.schema), NOW)(parse(expr)).column.alias("result"))


# --- structure and chunking ---------------------------------------------------------------------


@query(f"WITH {TURNS}, {EDGES} SELECT src, dst, rel FROM edges WHERE rel IN ('sequential_next', 'sequential_prev')")
def seq_edges(spark, d):
    return structure.sequential_edges(turns(spark, d))


@query(f"WITH {TURNS}, {EDGES} SELECT src, dst, rel FROM edges WHERE rel = 'parent'")
def parent_edges(spark, d):
    return structure.parent_edges(turns(spark, d))


@query(f"WITH {TURNS}, {EDGES} SELECT src, dst, rel FROM edges WHERE rel = 'child'")
def child_edges(spark, d):
    return structure.child_edges(turns(spark, d))


@query(f"WITH {TURNS}, {EDGES} SELECT src, dst, rel FROM edges WHERE rel = 'sibling'")
def sibling_edges(spark, d):
    return structure.sibling_edges(turns(spark, d))


@query(f"""WITH {TURNS}, {EDGES} SELECT c.chunk_id, concat_ws(' > ', CASE WHEN c.header_level > 2 AND g.chunk_id IS NOT NULL THEN g.header_text END, p.header_text) AS path
  FROM tree c LEFT JOIN tree p ON p.chunk_id = c.parent_id LEFT JOIN chunks g ON g.chunk_id = p.parent_id""")
def header_path(spark, d):
    return structure.header_path(turns(spark, d))


@query(f"WITH {TURNS} SELECT chunk_id, round(importance_score, 6) AS importance FROM chunks")
def importance(spark, d):
    return turns(spark, d).select("chunk_id", F.round("importance_score", 6).alias("importance"))


@query(f"""WITH {TURNS}, s AS (SELECT *, chunk_type || ': ' || substr(content, 1, 100) || '...' AS say FROM chunks)
  SELECT chunk_id, lag(say) OVER w AS preceding_context, lead(say) OVER w AS following_context FROM s WINDOW w AS (PARTITION BY note_id ORDER BY seq)""")
def context_links(spark, d):
    return structure.context_links(turns(spark, d))


@query(f"WITH {TURNS} SELECT chunk_id, count(*) OVER (PARTITION BY note_id) - 1 AS others FROM chunks")
def note_chunks(spark, d):
    return structure.note_chunks(turns(spark, d))


_LINES = """l AS (SELECT doc_id AS note_id, unnest(string_split(coalesce(text, ''), chr(10))) AS content, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS line FROM documents),
t AS (SELECT note_id, line, content, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS s FROM l),
typed AS (SELECT note_id, line::INT AS line, content, CASE WHEN s = '' THEN 'empty' WHEN s[1] = '#' THEN 'header' WHEN starts_with(s, '```') THEN 'code_fence' WHEN s[1] = '>' THEN 'quote'
  WHEN regexp_matches(s, '^(?:[-*+]|\\d+\\.)\\s+') THEN 'list_item' WHEN s[1] = '|' AND s[-1] = '|' THEN 'table_row' WHEN regexp_matches(s, '^[-= ]+$') THEN 'separator' ELSE 'text' END AS line_type FROM t)"""


@query(f"WITH {_LINES} SELECT note_id, line, content, line_type FROM typed")
def line_types(spark, d):
    return chunking.line_types(table(spark, d, "documents"), "doc_id")


@query(f"""WITH {_LINES}, g AS (SELECT *, line - row_number() OVER (PARTITION BY note_id, line_type ORDER BY line) AS run FROM typed)
  SELECT note_id, line_type, min(line) AS start_line, max(line) AS end_line FROM g GROUP BY note_id, line_type, run""")
def block_runs(spark, d):
    return chunking.block_runs(chunking.line_types(table(spark, d, "documents"), "doc_id"))


@query(r"""WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS x, length(coalesce(text, '')) AS n FROM documents),
  ends(doc_id, k, b1, stop) AS (
    SELECT doc_id, 0, 0, CASE WHEN n <= 1800 THEN n ELSE CASE WHEN 1800 - strpos(reverse(translate(substr(x, 1, 1800), chr(10), ' ')), ' ') > 0 AND strpos(translate(substr(x, 1, 1800), chr(10), ' '), ' ') > 0
      THEN 1800 - strpos(reverse(translate(substr(x, 1, 1800), chr(10), ' ')), ' ') ELSE 1800 END END FROM t
    UNION ALL SELECT doc_id, k + 1, b2, CASE WHEN b2 + 1800 >= n THEN n WHEN strpos(w, ' ') > 0 AND 1800 - strpos(reverse(w), ' ') > 0 THEN b2 + 1800 - strpos(reverse(w), ' ') ELSE b2 + 1800 END
      FROM (SELECT e.doc_id, k, n, greatest(b1 + 1, stop - 200) AS b2, translate(substr(x, greatest(b1 + 1, stop - 200) + 1, 1800), chr(10), ' ') AS w FROM ends e JOIN t USING (doc_id) WHERE b1 + 1800 < n)),
  cut AS (SELECT doc_id, k, CASE WHEN n <= 1800 THEN x ELSE regexp_replace(substr(x, b1 + 1, stop - b1), '^\s+|\s+$', '', 'g') END AS content, n FROM ends JOIN t USING (doc_id)),
  kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS seq FROM cut WHERE n <= 1800 OR content <> '')
  SELECT doc_id::VARCHAR AS note_id, doc_id || '#chunk=' || seq AS chunk_id, seq::INT AS seq, content FROM kept""")
def chunk_char(spark, d):
    return chunking.character_chunks(table(spark, d, "documents"), "doc_id")


@query(r"""WITH l AS (SELECT doc_id AS note_id, unnest(string_split(coalesce(text, ''), chr(10))) AS content, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS line FROM documents),
  f AS (SELECT *, sum(starts_with(content, '```')::INT) OVER (PARTITION BY note_id ORDER BY line) AS fences FROM l),
  h AS (SELECT *, fences % 2 = 0 AND regexp_matches(content, '^#{1,6}\s+.+$') AS head FROM f), s AS (SELECT *, sum(head::INT) OVER (PARTITION BY note_id ORDER BY line) AS section FROM h),
  g AS (SELECT note_id, section::INT AS section, min(line)::INT AS start_line, max(line)::INT AS end_line, (sum(length(content) + 1) - 1)::BIGINT AS size, max(CASE WHEN head THEN length(regexp_extract(content, '^(#{1,6})\s', 1)) END)::INT AS level,
    max(CASE WHEN head THEN regexp_replace(regexp_extract(content, '^#{1,6}\s+(.+)$', 1), '^\s+|\s+$', '', 'g') END) AS title FROM s GROUP BY note_id, section)
  SELECT g.*, (SELECT p.title FROM g p WHERE p.note_id = g.note_id AND p.section < g.section AND p.level < g.level ORDER BY p.section DESC LIMIT 1) AS above FROM g""")
def note_sections(spark, d):
    """Every document's sections: lines, size, header and the header above it."""
    found = sections.sections(sections.lines_in_sections(table(spark, d, "documents"), "doc_id"))
    return found.select(F.col("note_id").cast("long").alias("note_id"), "section", "start_line", "end_line", "size", "level", "title", F.try_element_at("above", F.lit(-1)).alias("above"))


@query()
def chunk_semantic(spark, d):
    return structure.with_importance(sections.chunk_notes(table(spark, d, "documents"), "doc_id"))


@query("SELECT 'doc-' || doc_id AS note_id, '## Intro' || chr(10) || chr(10) || 'new' || chr(10) || chr(10) || '## Body' || chr(10) || coalesce(text, '') AS text FROM documents")
def section_replace(spark, d):
    """Every document as the second section of a note; the first is replaced, whatever the second holds."""
    whole = F.concat(F.lit("## Intro\nold\n### deep\nx\n## Body\n"), F.coalesce("text", F.lit("")))
    n = table(spark, d, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("note_id"), whole.alias("text"))
    return mutations.replace_sections(n, " intro ", "new")


# --- graph --------------------------------------------------------------------------------------

_BOTH = f"{LINKS}, both_ways AS (SELECT src, dst FROM links UNION SELECT dst, src FROM links)"
_D2 = _BOTH + """, n0 AS (SELECT 's1' AS node, 0 AS depth), n1 AS (SELECT DISTINCT dst AS node, 1 AS depth FROM both_ways WHERE src = 's1' AND dst <> 's1'),
n2 AS (SELECT DISTINCT dst AS node, 2 AS depth FROM both_ways WHERE src IN (SELECT node FROM n1) AND dst NOT IN (SELECT node FROM n1) AND dst <> 's1')"""


def _seed(spark):
    return spark.createDataFrame([("s1",)], "node string")


@query(f"WITH {_D2} SELECT * FROM n0 UNION ALL SELECT * FROM n1")
def neighbors_d1(spark, d):
    return graph.neighbors(links(spark, d), _seed(spark), 1)


@query(f"WITH {_D2} SELECT * FROM n0 UNION ALL SELECT * FROM n1 UNION ALL SELECT * FROM n2")
def neighbors_d2(spark, d):
    return graph.neighbors(links(spark, d), _seed(spark), 2)


@query(f"WITH {_D2} SELECT node FROM n0 UNION ALL SELECT node FROM n1")
def subgraph_nodes(spark, d):
    return graph.neighbors(links(spark, d), _seed(spark), 1).select("node")


_INSIDE = f"{_D2}, inside AS (SELECT node FROM n0 UNION ALL SELECT node FROM n1 UNION ALL SELECT node FROM n2), inner_edges AS (SELECT src, dst FROM links WHERE src IN (SELECT node FROM inside) AND dst IN (SELECT node FROM inside))"


@query(f"WITH {_INSIDE} SELECT src, dst FROM inner_edges")
def subgraph_edges(spark, d):
    e = links(spark, d)
    return graph.subgraph_edges(e, graph.neighbors(e, _seed(spark), 2))


@query(f"WITH {_INSIDE} SELECT (SELECT count(*) FROM inside) AS node_count, (SELECT count(*) FROM inner_edges) AS edge_count")
def subgraph_stats(spark, d):
    e = links(spark, d)
    return graph.subgraph_stats(e, graph.neighbors(e, _seed(spark), 2))


@query(f"WITH {TURNS}, {EDGES} SELECT src, dst, rel, ord::INT AS ord, c.chunk_type, c.header_text, round(c.importance_score, 6) AS importance_score FROM edges JOIN chunks c ON c.chunk_id = dst")
def chunk_neighbors(spark, d):
    c = turns(spark, d)
    return graph.chunk_neighbors(structure.chunk_edges(c), c).withColumn("importance_score", F.round("importance_score", 6))


_WALK = f"""{TURNS}, {EDGES}, w0 AS (SELECT 'conv-1/chunk_1' AS chunk_id, 0 AS depth, 'start' AS rel, NULL::VARCHAR AS via),
w1 AS (SELECT dst AS chunk_id, 1 AS depth, rel, src AS via FROM edges WHERE src IN (SELECT chunk_id FROM w0) AND dst NOT IN (SELECT chunk_id FROM w0) QUALIFY row_number() OVER (PARTITION BY dst ORDER BY ord, src) = 1),
w2 AS (SELECT dst AS chunk_id, 2 AS depth, rel, src AS via FROM edges WHERE src IN (SELECT chunk_id FROM w1) AND dst NOT IN (SELECT chunk_id FROM w0 UNION ALL SELECT chunk_id FROM w1) QUALIFY row_number() OVER (PARTITION BY dst ORDER BY ord, src) = 1),
walk AS (SELECT * FROM w0 UNION ALL SELECT * FROM w1 UNION ALL SELECT * FROM w2)"""


def _walk(spark, d):
    c = turns(spark, d)
    return graph.traverse(structure.chunk_edges(c), spark.createDataFrame([("conv-1/chunk_1",)], "chunk_id string"), 2)


@query(f"WITH {_WALK} SELECT chunk_id, depth, rel, via FROM walk")
def traverse_chunk(spark, d):
    return _walk(spark, d)


@query(f"WITH {_WALK} SELECT rel, count(*) AS n, max(depth)::BIGINT AS deepest FROM walk WHERE depth > 0 GROUP BY rel")
def traverse_summary(spark, d):
    return graph.traverse_summary(_walk(spark, d))


@query(f"""WITH {TURNS}, p AS (SELECT c.*, (SELECT max(p.seq) FROM chunks p WHERE p.note_id = c.note_id AND p.seq < c.seq AND p.header_level < c.header_level) AS parent_seq FROM chunks c)
  SELECT note_id, header_level, 'conv-' || split_part(note_id, '-', 2) || '/chunk_' || parent_seq AS parent_id, min(seq) AS first, max(seq) AS last, count(*) AS members FROM p GROUP BY note_id, header_level, parent_seq""")
def sibling_classes(spark, d):
    """Classes of siblings, each with its range of places; no pairs."""
    return structure.sibling_classes(turns(spark, d)).groupBy("class", "note_id", "header_level", "parent_id").agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.count(F.lit(1)).alias("members")).drop("class")


_LINKING = f"""{TURNS}, {EDGES}, starts AS (SELECT chunk_id, conv_id, turn FROM (SELECT conv_id, turn, 'conv-' || conv_id || '/chunk_' || turn AS chunk_id FROM conversations WHERE conv_id % 50 = 0 AND turn = 1)),
linked AS (SELECT DISTINCT s.chunk_id AS src, c.chunk_id AS dst, 'content_link' AS rel, 6 AS ord FROM starts s, unnest([2, 3, 4]) t(m)
  JOIN (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY seq, chunk_id) AS head FROM chunks) c ON c.note_id = 'conv-' || (s.conv_id * m + s.turn) AND head <= 2 WHERE s.chunk_id <> c.chunk_id),
l0 AS (SELECT chunk_id, 0 AS depth, 'start' AS rel, NULL::VARCHAR AS via FROM starts),
l1 AS (SELECT dst AS chunk_id, 1 AS depth, rel, src AS via FROM (SELECT src, dst, rel, ord FROM edges UNION ALL SELECT src, dst, rel, ord FROM linked) WHERE src IN (SELECT chunk_id FROM l0) AND dst NOT IN (SELECT chunk_id FROM l0) QUALIFY row_number() OVER (PARTITION BY dst ORDER BY ord, src) = 1),
l2 AS (SELECT dst AS chunk_id, 2 AS depth, rel, src AS via FROM edges WHERE src IN (SELECT chunk_id FROM l1) AND dst NOT IN (SELECT chunk_id FROM l0 UNION ALL SELECT chunk_id FROM l1) QUALIFY row_number() OVER (PARTITION BY dst ORDER BY ord, src) = 1)"""


@query(f"WITH {_LINKING} SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2")
def traverse_linked(spark, d):
    """From the second turn of every fiftieth conversation: chunk relations, and at the first level the conversations that it names."""
    c = turns(spark, d)
    conv, turn = F.regexp_extract("chunk_id", r"^conv-(\d+)/", 1).cast("long"), F.col("seq")
    # every turn names four conversations, in other letters; the first three count
    c = c.withColumn("contains_links", F.transform(F.sequence(F.lit(2), F.lit(5)), lambda m: F.concat(F.lit("CONVERSATION "), (conv * m + turn).cast("string"))))
    n = c.select("note_id").distinct().withColumns({"title": F.replace("note_id", F.lit("conv-"), F.lit("conversation ")), "stem": F.col("note_id")})
    starts = c.filter((conv % 50 == 0) & (turn == 1)).select("chunk_id")
    return graph.traverse(structure.chunk_edges(c), starts, 2, graph.content_links(starts, c, n))


@query(f"""WITH {TURNS}, {EDGES}, here AS (SELECT note_id AS n, seq AS s FROM chunks WHERE chunk_id = 'conv-1/chunk_1')
  SELECT chunk_id, CASE WHEN seq = s THEN 'target' WHEN seq < s THEN 'previous' ELSE 'next' END AS role, abs(seq - s)::BIGINT AS distance FROM chunks, here WHERE note_id = n AND abs(seq - s) <= 2
  UNION ALL SELECT dst, rel, 0 FROM edges WHERE src = 'conv-1/chunk_1' AND rel IN ('parent', 'child')""")
def chunk_context(spark, d):
    c = turns(spark, d)
    return search.chunk_context(structure.chunk_edges(c), c, "conv-1/chunk_1", 2)


@query(f"WITH {_BOTH} SELECT DISTINCT a.dst AS node FROM both_ways a JOIN both_ways b ON a.dst = b.dst WHERE a.src = 's1' AND b.src = 's2'")
def ext_common_neighbors(spark, d):
    return graph.common_neighbors(links(spark, d), "s1", "s2")


@query(f"""WITH RECURSIVE {_BOTH}, reach(node, component) AS (SELECT src, src FROM both_ways UNION SELECT b.dst, r.component FROM reach r JOIN both_ways b ON b.src = r.node WHERE r.component = (SELECT min(src) FROM both_ways)),
  first AS (SELECT node FROM reach WHERE component = (SELECT min(src) FROM both_ways)) SELECT node, (SELECT min(src) FROM both_ways) AS component FROM first""")
def ext_component_of_least(spark, d):
    """The component that holds the least node; all components are tested against a plain search."""
    c = graph.connected(links(spark, d))
    return c.join(c.agg(F.min("component").alias("component")), "component", "left_semi").select("node", "component")


@query("""WITH RECURSIVE e AS (SELECT 'd' || doc_id AS a, 'd' || (doc_id + 3) AS b FROM documents WHERE doc_id % 7 <> 0), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
  reach(node, other) AS (SELECT a, a FROM u UNION SELECT r.node, u.b FROM reach r JOIN u ON u.a = r.other) SELECT node, min(other) AS component FROM reach GROUP BY node""")
def ext_components(spark, d):
    """All components of a graph of many short chains."""
    e = table(spark, d, "documents").filter("doc_id % 7 <> 0")
    name = lambda c: F.concat(F.lit("d"), c.cast("string"))
    return graph.connected(e.select(name(F.col("doc_id")).alias("src"), name(F.col("doc_id") + 3).alias("dst")))


@query("SELECT 1 AS step, 'x' AS node WHERE false UNION ALL SELECT 0, 's1' UNION ALL SELECT 1, (SELECT min('p' || a.l_partkey) FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey WHERE a.l_suppkey = 1 AND b.l_suppkey = 2) UNION ALL SELECT 2, 's2'")
def ext_shortest_path(spark, d):
    return graph.shortest_path(links(spark, d), "s1", "s2", 3)


# --- search -------------------------------------------------------------------------------------


def _near(spark, d, k=8):
    """The nearest passages of one, all passages, those of the same notes, and the relations among these."""
    v = passages(spark, d)
    e = table(spark, d, "embeddings").select(F.concat(F.lit("vec-"), F.col("vec_id").cast("string")).alias("chunk_id"), F.concat(F.lit("note-"), F.floor(F.col("vec_id") / 10).cast("string")).alias("note_id"), "embedding")
    near = search.settled(search.knn(e, search.vector_of(e, "vec-7"), k, keep=("note_id",)))
    local = search.around(near, v)
    return near.select("chunk_id", "distance"), v, local, structure.chunk_edges(local)


def _nearest(distance: str, where: str = "true") -> str:
    """SQL of the ten nearest of every vector whose id is divisible by 50."""
    return f"""WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id % 50 = 0),
  pairs AS (SELECT qid, 'vec-' || vec_id AS chunk_id, round({distance}, 9) AS distance FROM q, (SELECT *, embedding::DOUBLE[] AS b FROM embeddings WHERE {where}))
  SELECT qid, chunk_id, round(distance, 6) AS distance FROM pairs QUALIFY row_number() OVER (PARTITION BY qid ORDER BY distance, chunk_id) <= 10"""


def _knn(spark, d, metric="l2", where=None):
    """Every vector whose id is divisible by 50, against all."""
    e = table(spark, d, "embeddings").select("vec_id", F.concat(F.lit("vec-"), F.col("vec_id").cast("string")).alias("chunk_id"), "embedding", "label")
    asked = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    return search.knn_many(e, asked, 10, metric, where).withColumn("distance", F.round("distance", 6))


@query(_nearest("pow(list_distance(a, b), 2)"))
def knn_l2(spark, d):
    return _knn(spark, d)


@query(_nearest("list_cosine_distance(a, b)"))
def knn_cosine(spark, d):
    return _knn(spark, d, "cosine")


@query(_nearest("pow(list_distance(a, b), 2)", "label = 2"))
def knn_filtered(spark, d):
    return _knn(spark, d, where=F.col("label") == 2)


@query("SELECT 'vec-' || vec_id AS chunk_id, round(pow(list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)), 2), 6) AS distance FROM embeddings ORDER BY distance, chunk_id LIMIT 10")
def knn_one(spark, d):
    """A single search, as the engine asks it: no Python, k rows a task."""
    e = table(spark, d, "embeddings").select(F.concat(F.lit("vec-"), F.col("vec_id").cast("string")).alias("chunk_id"), "embedding")
    return search.knn(e, search.vector_of(e, "vec-7"), 10).withColumn("distance", F.round("distance", 6))


def _bigrams(x: str) -> str:
    return f"list_distinct(list_transform(range(1, length({x})), lambda i: substr({x}, i, 2)))"


def _fuzzy(a: str, b: str) -> str:
    shared = f"len(list_intersect({_bigrams(a)}, {_bigrams(b)}))"
    union = f"len(list_distinct(list_concat({_bigrams(a)}, {_bigrams(b)})))"
    return f"""CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 WHEN length({a}) < 2 AND length({b}) < 2 THEN ({a} = {b})::INT WHEN length({a}) < 2 OR length({b}) < 2 THEN 0
      ELSE ({shared} / {union}::DOUBLE * 0.7 + (1 - abs(length({a}) - length({b})) / greatest(length({a}), length({b}))::DOUBLE) * 0.3) * 0.5 END"""


@query(f"SELECT p_partkey, round(({_fuzzy('p_name', 'p_type')})::DOUBLE, 9) AS score FROM part")
def fuzzy_string(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(text.fuzzy_string(F.col("p_name"), F.col("p_type")), 9).alias("score"))


ENTITIES = ["de", "src3", "qualty"]


def _tag_score(e: str) -> str:
    lit = f"'{e}'"
    partial = f"CASE WHEN contains(t, '/') AND len(list_filter(string_split(t, '/'), lambda p: contains(p, {lit}) OR contains({lit}, p))) > 0 THEN 0.7 ELSE 0 END"
    return f"""CASE WHEN t = {lit} THEN 1.0 WHEN contains(t, '/') AND list_contains(string_split(t, '/'), {lit}) THEN 0.9
      ELSE greatest({partial}, CASE WHEN contains(t, {lit}) THEN 0.8 WHEN contains({lit}, t) THEN 0.6 ELSE 0 END, {_fuzzy(lit, 't')}) END"""


_TAG_SCORES = f"""{NOTE_TAGS}, per AS (SELECT note_id, lower(tag) AS t FROM note_tags),
scored AS (SELECT note_id, round(({' + '.join(f'max({_tag_score(e)})' for e in ENTITIES)})::DOUBLE / {len(ENTITIES)}, 9) AS score FROM per GROUP BY note_id)"""


@query(f"WITH {_TAG_SCORES} SELECT note_id, score FROM scored")
def tag_relevance(spark, d):
    return notes(spark, d).select("note_id", F.round(text.tag_relevance(ENTITIES, F.col("tags")), 9).alias("score"))


@query(f"WITH {_TAG_SCORES} SELECT note_id, score, round(1 - score, 9) AS distance FROM scored WHERE score > 0 ORDER BY score DESC, note_id LIMIT 20")
def fuzzy_tag_search(spark, d):
    return search.fuzzy_tag_search(notes(spark, d), ENTITIES, 20).withColumn("distance", F.round("distance", 9))


_TERMS = text.terms_of(QUERY_TEXT)


def _relevance(c: str) -> str:
    found = " + ".join(f"(length(lower({c})) - length(replace(lower({c}), '{t}', ''))) / {len(t)}.0" for t in _TERMS)
    return f"CASE WHEN coalesce(length({c}), 0) = 0 THEN 0 ELSE least(({found}) / (length({c}) / 100.0 + {len(_TERMS)}), 1.0) END"


@query(f"SELECT doc_id, round(({_relevance('text')})::DOUBLE, 6) AS relevance FROM documents")
def text_relevance(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(text.text_relevance(F.col("text"), QUERY_TEXT), 6).alias("relevance"))


_WEIGHT = "CASE rel WHEN 'sequential_next' THEN 0.8 WHEN 'sequential_prev' THEN 0.8 WHEN 'parent' THEN 0.9 WHEN 'child' THEN 0.7 WHEN 'sibling' THEN 0.6 WHEN 'content_link' THEN 0.9 ELSE 0.5 END"


@query(f"WITH {TURNS}, {EDGES} SELECT src, dst, rel, round(({_WEIGHT})::DOUBLE * pow(0.8::DOUBLE, ord - 1), 9) AS weight FROM edges")
def rel_weight(spark, d):
    return graph.steps(structure.chunk_edges(turns(spark, d))).select("src", "dst", "rel", F.round(scoring.relation_weight(F.col("rel"), F.col("ord") - 1), 9).alias("weight"))


_NAMED = " OR ".join(f"contains(lower(header_text), '{t}')" for t in QUERY_TEXT.lower().split())
_CANDIDATES = f"""{PASSAGES}, {NEAR}, cand AS (SELECT chunk_id, distance, round((1 - distance + CASE WHEN importance_score > 0.7 THEN 0.1 ELSE 0 END + CASE WHEN chunk_type IN ('section', 'header') THEN 0.05 ELSE 0 END
  + CASE WHEN {_NAMED} THEN 0.08 ELSE 0 END)::DOUBLE, 9) AS score FROM near8 JOIN chunks USING (chunk_id) ORDER BY score DESC, chunk_id LIMIT 3)"""


@query(f"WITH {_CANDIDATES} SELECT chunk_id, round(distance, 6) AS distance, round(score, 6) AS score FROM cand")
def expansion_candidates(spark, d):
    near, c, local, edges = _near(spark, d)
    return search.expansion_candidates(near, local, QUERY_TEXT, 6).withColumn("distance", F.round("distance", 6)).withColumn("score", F.round("score", 6))


def _level(n: int) -> str:
    seen = " UNION ALL ".join(f"SELECT chunk_id FROM x{k}" for k in range(n))
    return f"""x{n} AS (SELECT dst AS chunk_id, {n} AS level, round((x.score * 0.4 + c.importance_score * 0.4 + ({_WEIGHT})::DOUBLE * pow(0.8::DOUBLE, {n - 1}) * 0.2)::DOUBLE, 12) AS score, src AS source, e.rel
  FROM x{n - 1} x JOIN edges e ON e.src = x.chunk_id JOIN chunks c ON c.chunk_id = dst WHERE c.importance_score >= 0.3 AND dst NOT IN ({seen})
  AND round((x.score * 0.4 + c.importance_score * 0.4 + ({_WEIGHT.replace('CASE rel', 'CASE e.rel')})::DOUBLE * pow(0.8::DOUBLE, {n - 1}) * 0.2)::DOUBLE, 12) > 0.3
  QUALIFY row_number() OVER (PARTITION BY dst ORDER BY score DESC, ord, src) = 1)""".replace(f"({_WEIGHT})", f"({_WEIGHT.replace('CASE rel', 'CASE e.rel')})").replace("ORDER BY score DESC", f"ORDER BY round((x.score * 0.4 + c.importance_score * 0.4 + ({_WEIGHT.replace('CASE rel', 'CASE e.rel')})::DOUBLE * pow(0.8::DOUBLE, {n - 1}) * 0.2)::DOUBLE, 12) DESC")


_EXPANDED = f"""{_CANDIDATES}, {EDGES}, x0 AS (SELECT chunk_id, 0 AS level, (1 - distance)::DOUBLE AS score, chunk_id AS source, 'direct' AS rel FROM cand), {_level(1)}, {_level(2)},
expanded AS (SELECT u.chunk_id, level, score * CASE WHEN level = 0 THEN 1.2 ELSE 1.0 END + ({_relevance('content')})::DOUBLE * 0.1 AS final_score, source, rel
  FROM (SELECT * FROM x0 UNION ALL SELECT * FROM x1 UNION ALL SELECT * FROM x2) u JOIN chunks USING (chunk_id))"""


@query(f"WITH {_EXPANDED} SELECT chunk_id, level, round(final_score, 6) AS final_score, source, rel FROM expanded")
def expand_rank(spark, d):
    near, c, local, edges = _near(spark, d)
    return search.expand_rank(near, edges, local, QUERY_TEXT).withColumn("final_score", F.round("final_score", 6))


@query()
def mmr(spark, d):
    near, c, local, edges = _near(spark, d)
    found = search.expand_rank(near, edges, local, QUERY_TEXT).withColumn("qid", F.lit("q1"))
    return search.mmr(found.join(local.select("chunk_id", "note_id", "chunk_type", "header_text"), "chunk_id").select("qid", "chunk_id", "note_id", "chunk_type", "header_text", "final_score"), 6)


_GRAPH = f"""{PASSAGES}, {NEAR}, {EDGES}, listed AS (SELECT src, dst, rel, ord, c.importance_score AS i FROM edges JOIN chunks c ON c.chunk_id = dst WHERE src IN (SELECT chunk_id FROM near8) QUALIFY row_number() OVER (PARTITION BY src ORDER BY ord, dst) <= 3),
hits AS (SELECT chunk_id, distance, 1 - distance AS final_score, 'vector_search' AS retrieval_method, []::VARCHAR[] AS relationships, 0 AS ord FROM near8
  UNION ALL SELECT dst, 1 - i, i, 'graph_traversal', [rel], ord FROM listed)"""


@query(f"WITH {_GRAPH} SELECT chunk_id, round(distance, 6) AS distance, round(final_score, 6) AS final_score, retrieval_method, relationships, ord::INT AS ord FROM hits")
def graph_search(spark, d):
    near, c, local, edges = _near(spark, d)
    return search.graph_search(near, edges, local).withColumn("distance", F.round("distance", 6)).withColumn("final_score", F.round("final_score", 6))


_DEDUPED = """best AS (SELECT chunk_id, distance, final_score, retrieval_method, ord FROM hits QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY coalesce(final_score, 0) DESC, ord) = 1),
rels AS (SELECT chunk_id, list_sort(list_distinct(flatten(list(relationships)))) AS relationships FROM hits GROUP BY chunk_id)"""


@query(f"WITH {_GRAPH}, {_DEDUPED} SELECT chunk_id, round(distance, 6) AS distance, round(final_score, 6) AS final_score, retrieval_method, relationships, ord::INT AS ord FROM best JOIN rels USING (chunk_id)")
def dedupe_hits(spark, d):
    near, c, local, edges = _near(spark, d)
    return search.dedupe_hits(search.graph_search(near, edges, local)).select("chunk_id", F.round("distance", 6).alias("distance"), F.round("final_score", 6).alias("final_score"), "retrieval_method", "relationships", "ord")


_HYBRID = f"""{PASSAGES}, {NEAR}, {EDGES}, one AS (SELECT chunk_id FROM near8 ORDER BY distance, chunk_id LIMIT 1),
listed AS (SELECT src, dst, rel, ord, c.importance_score AS i FROM edges JOIN chunks c ON c.chunk_id = dst WHERE src IN (SELECT chunk_id FROM one) QUALIFY row_number() OVER (PARTITION BY src ORDER BY ord, dst) <= 5),
per AS (SELECT chunk_id, lower(unnest(tags)) AS t FROM chunks), tagged AS (SELECT chunk_id, round(({' + '.join(f'max({_tag_score(e)})' for e in ENTITIES)})::DOUBLE / {len(ENTITIES)}, 9) AS score FROM per GROUP BY chunk_id ORDER BY score DESC, chunk_id LIMIT 2),
hits AS (SELECT chunk_id, distance, 1 - distance AS final_score, 'vector_search' AS retrieval_method, []::VARCHAR[] AS relationships, 0 AS ord FROM near8
  UNION ALL SELECT chunk_id, 1 - score, score, 'tag_search', []::VARCHAR[], 9 FROM tagged UNION ALL SELECT dst, 1 - i, i, 'graph_traversal', [rel], ord FROM listed), {_DEDUPED}"""
_HITS = "SELECT chunk_id, round(coalesce(final_score, 1 - distance, 0), 6) AS rank_score, retrieval_method, relationships FROM best JOIN rels USING (chunk_id) ORDER BY round(coalesce(final_score, 1 - distance, 0), 9) DESC, chunk_id LIMIT 6"


def _hybrid(spark, d):
    near, c, local, edges = _near(spark, d)
    tagged = search.fuzzy_tag_search(c.select(F.col("chunk_id").alias("note_id"), "tags"), ENTITIES, 20).withColumnRenamed("note_id", "chunk_id")
    return search.hybrid_search(near, tagged, edges, local, 6), c


@query(f"WITH {_HYBRID} {_HITS}")
def hybrid_search(spark, d):
    return _hybrid(spark, d)[0].select("chunk_id", F.round("rank_score", 6).alias("rank_score"), "retrieval_method", "relationships")


@query(f"WITH {_HYBRID}, top AS ({_HITS}) SELECT chunk_id, rank_score, retrieval_method, note_id, content, chunk_type, round(importance_score, 6) AS importance_score FROM top JOIN chunks USING (chunk_id)")
def hydrate_hits(spark, d):
    hits, c = _hybrid(spark, d)
    return search.hydrate(hits.select("chunk_id", F.round("rank_score", 6).alias("rank_score"), "retrieval_method"), c).withColumn("importance_score", F.round("importance_score", 6))


@query(f"WITH {_HYBRID}, top AS ({_HITS}) SELECT chunk_id, round(importance_score, 6) AS importance_score FROM chunks WHERE chunk_id IN (SELECT dst FROM edges WHERE src IN (SELECT chunk_id FROM near8)) AND chunk_id NOT IN (SELECT chunk_id FROM top) AND importance_score >= 0.3 ")
def related_minus_primary(spark, d):
    near, c, local, edges = _near(spark, d)
    return search.related_minus_primary(search.related_chunks(near, edges, local, n=None), _hybrid(spark, d)[0]).select("chunk_id", F.round("importance_score", 6).alias("importance_score"))


@query(f"WITH {PASSAGES}, {NEAR}, {EDGES} SELECT dst AS chunk_id, round(max(c.importance_score), 6) AS importance_score, min(rel) AS rel FROM edges JOIN chunks c ON c.chunk_id = dst WHERE src IN (SELECT chunk_id FROM near8) AND c.importance_score >= 0.3 GROUP BY dst ORDER BY max(c.importance_score) DESC, dst LIMIT 10")
def related_chunks(spark, d):
    near, c, local, edges = _near(spark, d)
    return search.related_chunks(near, edges, local).withColumn("importance_score", F.round("importance_score", 6))


_INTENT = {n: p for n, _, p, _ in intents.INTENTS}


def _intent_sql(c: str) -> str:
    hit = {n: f"regexp_matches({c}, '(?i){p}')" for n, p in _INTENT.items()}
    none = " AND ".join(f"NOT {h}" for h in hit.values())
    return f"""SELECT conv_id, turn, CASE WHEN {hit['categorical']} THEN 'categorical' WHEN {hit['relationship']} THEN 'relationship' WHEN {none} THEN 'semantic' WHEN {hit['specific']} THEN 'specific' ELSE 'semantic' END AS intent_type,
      CASE WHEN {hit['categorical']} THEN 0.8 WHEN {hit['relationship']} THEN 0.7 WHEN {none} THEN 0.8 ELSE 0.6 END::DOUBLE AS intent_confidence,
      CASE WHEN {hit['categorical']} AND {hit['semantic']} THEN 'hybrid' WHEN {hit['categorical']} THEN 'tag' WHEN {hit['relationship']} THEN 'graph' ELSE 'vector' END AS strategy FROM conversations"""


@query(_intent_sql("text"))
def query_intent(spark, d):
    c = table(spark, d, "conversations")
    made = intents.intent(F.col("text"))
    return c.select("conv_id", "turn", *[made[k].alias(k) for k in ("intent_type", "intent_confidence", "strategy")])


@query(f"""WITH c AS (SELECT conv_id, turn, text, lower(text) AS l FROM conversations)
  SELECT conv_id, turn, CASE WHEN {' + '.join(f"contains(l, '{m.replace(chr(39), chr(39) * 2)}')::INT" for m in intents.COMPLEX_MARKS)} > {' + '.join(f"contains(l, '{m}')::INT" for m in intents.SIMPLE_MARKS)}
  OR len(list_filter(regexp_split_to_array(text, '[^\\pL\\pN_]+'), lambda x: regexp_full_match(x, '[A-Z][a-z]+'))) > 2 OR regexp_matches(text, '(?s)\\?.') THEN 'complex' ELSE 'simple' END AS complexity FROM c""")
def complexity(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", intents.complexity(F.col("text")).alias("complexity"))


@query(f"WITH {_HYBRID}, top AS ({_HITS}) SELECT round(least(1.0, greatest(0.0, 1 - (SELECT avg(distance) FROM near8)) + 0.05), 6)::DOUBLE AS confidence, CASE WHEN least(1.0, greatest(0.0, 1 - (SELECT avg(distance) FROM near8)) + 0.05) < 0.55 THEN 'degraded' ELSE 'ok' END AS status, CASE WHEN (SELECT avg(distance) FROM near8) > 0.55 THEN ['rephrase_question', 'add_entities', 'narrow_with_tag'] ELSE ['rephrase_question', 'narrow_with_tag', 'increase_k'] END AS advice")
def smart_search(spark, d):
    """Confidence, status and advice over the hits of one routed question."""
    near = _near(spark, d)[0]
    row = near.agg(F.avg("distance").alias("mean"), F.count(F.lit(1)).alias("n"))
    c = scoring.confidence(F.col("mean"), F.lit(None).cast("double"), F.lit(None).cast("double"), F.col("n"))
    score, status = scoring.search_status(F.col("n"), c, F.lit(False))
    return row.select(F.round(score, 6).alias("confidence"), status.alias("status"), scoring.recommendations(F.col("mean"), F.lit("graph"), F.lit(0), F.lit("closed")).alias("advice"))


@query("""SELECT label, round(greatest(0.0, least(1.0, CASE WHEN label % 2 = 0 THEN greatest(0.0, 1 - label / 10.0) ELSE (greatest(0.0, 1 - label / 10.0) + 0.5) / 2 END + CASE WHEN label >= 2 THEN 0.05 ELSE 0 END)), 6)::DOUBLE AS confidence
  FROM (SELECT DISTINCT label FROM embeddings)""")
def confidence(spark, d):
    e = table(spark, d, "embeddings").select("label").distinct()
    return e.select("label", F.round(scoring.confidence(F.col("label") / 10, F.when(F.col("label") % 2 == 1, 0.5), F.lit(0.0), F.col("label")), 6).alias("confidence"))


@query("""SELECT label, CASE WHEN label / 10.0 > 0.55 AND label % 2 = 0 THEN ['rephrase_question', 'add_entities', 'narrow_with_tag'] WHEN label / 10.0 > 0.55 THEN ['rephrase_question', 'add_entities', 'increase_k']
  WHEN label % 2 = 0 THEN ['rephrase_question', 'narrow_with_tag', 'increase_k'] ELSE ['rephrase_question', 'increase_k'] END AS advice FROM (SELECT DISTINCT label FROM embeddings)""")
def recommendations(spark, d):
    e = table(spark, d, "embeddings").select("label").distinct()
    return e.select("label", scoring.recommendations(F.col("label") / 10, F.when(F.col("label") % 2 == 0, "graph").otherwise("semantic"), F.lit(0), F.lit("closed")).alias("advice"))


@query("""SELECT doc_id, 'obsidian://open?vault=my%20vault&file=' || source || '/' || lang || '%20notes/doc-' || doc_id || '.md' || CASE WHEN text IS NULL OR trim(split_part(text, ' ', 1)) = '' THEN '' ELSE '#' || replace(replace(url_encode(regexp_replace(regexp_replace(regexp_replace(split_part(text, ' ', 1), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'), '[\\x00-\\x1F]', '', 'g')), '+', '%20'), '%7E', '~') END AS uri FROM documents""")
def chunk_uri(spark, d):
    path = F.concat(F.lit("/vaults/my vault/"), "source", F.lit("/"), "lang", F.lit(" notes/doc-"), F.col("doc_id").cast("string"))
    return table(spark, d, "documents").select("doc_id", text.chunk_uri(F.lit("/vaults/my vault"), path, F.split_part("text", F.lit(" "), F.lit(1)), ("/vaults/my vault",)).alias("uri"))


@query(f"WITH {_HYBRID}, top AS ({_HITS}) SELECT row_number() OVER (ORDER BY rank_score DESC, chunk_id)::INT AS place, '[' || row_number() OVER (ORDER BY rank_score DESC, chunk_id) || '] ' || header_text || ' (via ' || retrieval_method || ')' || chr(10) || content || chr(10) AS context FROM top JOIN chunks USING (chunk_id)")
def format_context(spark, d):
    from pyspark.sql import Window

    hits, c = _hybrid(spark, d)
    j = hits.select("chunk_id", F.round("rank_score", 6).alias("rank_score"), "retrieval_method").join(c.select("chunk_id", "header_text", "content"), "chunk_id")
    ranked = j.withColumn("place", F.row_number().over(Window.orderBy(F.desc("rank_score"), "chunk_id")))  # six rows
    return ranked.select("place", text.format_context(F.col("place"), F.col("header_text"), F.col("retrieval_method"), F.col("content")).alias("context"))


@query(r"SELECT doc_id, regexp_extract_all(coalesce(text, ''), '(?m)^#+\s+(.+)$', 1)[1:3] AS headings, len(regexp_extract_all(coalesce(text, ''), '(?m)^\s*[-*+]\s+.+$'))::INT AS items, regexp_extract_all(coalesce(text, ''), '\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}/\d{1,2}/\d{4}\b')[1:3] AS dates FROM documents")
def extract_properties(spark, d):
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", text.headings(t).alias("headings"), text.list_items(t).alias("items"), text.dates(t).alias("dates"))


@query(r"SELECT doc_id, array_to_string(list_transform(list_filter(string_split(text, '.'), lambda s: contains(lower(s), 'the') AND contains(lower(s), 'that'))[1:2], lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), '. ') AS found FROM documents")
def find_connections(spark, d):
    return table(spark, d, "documents").select("doc_id", text.sentences_with(F.col("text"), ["the", "that"], True).alias("found"))


@query(r"SELECT doc_id, array_to_string(list_transform(list_filter(string_split(text, '.'), lambda s: contains(lower(s), 'the') OR contains(lower(s), 'que'))[1:2], lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), '. ') AS found FROM documents")
def expand_context(spark, d):
    return table(spark, d, "documents").select("doc_id", text.sentences_with(F.col("text"), ["the", "que"], False).alias("found"))


# --- many questions in one plan -------------------------------------------------------------------

_W = "[\\pL\\pN_]+"
_ENTITY = f"list_transform(regexp_extract_all(question, '(?i)(?:#{_W}|tag[s]?\\s*[:=]\\s*{_W}|tagged\\s+with\\s+{_W})'), lambda m: regexp_extract(m, '({_W})$', 1))"


def _tag_score_of(e: str) -> str:
    """The score of tag t for the entity in column ``e``, in lower case."""
    return _tag_score("@").replace("'@'", e)


def _routing(c: str) -> str:
    hit = {n: f"regexp_matches({c}, '(?i){p}')" for n, p in _INTENT.items()}
    none = " AND ".join(f"NOT {h}" for h in hit.values())
    return f"""CASE WHEN {hit['categorical']} THEN 'categorical' WHEN {hit['relationship']} THEN 'graph' WHEN {none} THEN 'semantic' WHEN {hit['specific']} THEN 'specific' ELSE 'semantic' END AS kind,
      CASE WHEN {hit['categorical']} AND {hit['semantic']} THEN 'hybrid' WHEN {hit['categorical']} THEN 'tag' WHEN {hit['relationship']} THEN 'graph' ELSE 'vector' END AS strategy"""


#: Turns of every fiftieth conversation as questions of four kinds, with the vector of the same number.
_MANY = f"""{PASSAGES}, {EDGES}, q0 AS (SELECT conv_id || '-' || turn AS qid, ['', 'notes tagged with src3 ', 'what links to ', 'explain the idea of #de '][1 + turn % 4] || coalesce(text, '') AS question, e.embedding::DOUBLE[] AS a
  FROM conversations LEFT JOIN embeddings e ON e.vec_id = conv_id + turn WHERE conv_id % 50 = 0),
q AS (SELECT *, {_routing('question')}, CASE WHEN len({_ENTITY}) > 0 THEN {_ENTITY} ELSE list_filter(regexp_split_to_array(question, '\\s+'), lambda w: length(w) > 2)[1:3] END AS entities FROM q0),
pairs AS (SELECT qid, strategy, chunk_id, round(list_cosine_distance(a, embedding::DOUBLE[]), 9) AS distance FROM q JOIN chunks ON a IS NOT NULL AND strategy <> 'tag'),
found AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY qid ORDER BY distance, chunk_id) <= CASE strategy WHEN 'vector' THEN 6 ELSE 3 END),
ents AS (SELECT qid, strategy, len(entities) AS many, unnest(range(1, len(entities) + 1)) AS i, lower(unnest(entities)) AS e FROM q WHERE strategy IN ('tag', 'hybrid')),
kinds AS (SELECT DISTINCT lower(tag) AS t FROM (SELECT unnest(tags) AS tag FROM chunks)), of_chunk AS (SELECT DISTINCT chunk_id, lower(unnest(tags)) AS t FROM chunks),
matched AS (SELECT e, t, {_tag_score_of('e')} AS s FROM (SELECT DISTINCT e FROM ents) JOIN kinds ON true),
best_tag AS (SELECT qid, strategy, many, i, chunk_id, max(s) AS s FROM ents JOIN matched USING (e) JOIN of_chunk USING (t) GROUP BY ALL),
tagged AS (SELECT qid, strategy, chunk_id, round(sum(s)::DOUBLE / many, 9) AS score FROM best_tag GROUP BY qid, strategy, many, chunk_id HAVING sum(s) > 0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) <= 6),
beside AS (SELECT src, dst, rel, ord, c.importance_score AS i, row_number() OVER (PARTITION BY src ORDER BY ord, dst) AS n FROM edges JOIN chunks c ON c.chunk_id = dst),
hits AS (SELECT qid, chunk_id, distance, 1 - distance AS final_score, 'vector_search' AS retrieval_method, []::VARCHAR[] AS relationships, 0 AS ord FROM found
  UNION ALL SELECT qid, chunk_id, 1 - score, score, 'tag_search', []::VARCHAR[], 0 FROM tagged WHERE strategy = 'tag'
  UNION ALL SELECT qid, chunk_id, 1 - score, score, 'tag_search', []::VARCHAR[], 9 FROM (SELECT * FROM tagged WHERE strategy = 'hybrid' QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) <= 2)
  UNION ALL SELECT qid, dst, 1 - i, i, 'graph_traversal', [rel], ord FROM found JOIN beside ON src = chunk_id WHERE strategy = 'graph' AND n <= 3
  UNION ALL SELECT qid, dst, 1 - i, i, 'graph_traversal', [rel], ord FROM (SELECT * FROM found WHERE strategy = 'hybrid' QUALIFY row_number() OVER (PARTITION BY qid ORDER BY distance, chunk_id) = 1) JOIN beside ON src = chunk_id WHERE n <= 5),
one AS (SELECT qid, chunk_id, distance, final_score, retrieval_method FROM hits QUALIFY row_number() OVER (PARTITION BY qid, chunk_id ORDER BY coalesce(final_score, 0) DESC, ord) = 1),
rels AS (SELECT qid, chunk_id, list_sort(list_distinct(flatten(list(relationships)))) AS relationships FROM hits GROUP BY qid, chunk_id),
top AS (SELECT *, round(coalesce(final_score, 1 - distance, 0)::DOUBLE, 9) AS rank_score, row_number() OVER (PARTITION BY qid ORDER BY round(coalesce(final_score, 1 - distance, 0)::DOUBLE, 9) DESC, chunk_id) AS place FROM one JOIN rels USING (qid, chunk_id))"""


def _questions(spark, d):
    c = table(spark, d, "conversations").filter("conv_id % 50 = 0")
    lead = F.element_at(F.array(F.lit(""), F.lit("notes tagged with src3 "), F.lit("what links to "), F.lit("explain the idea of #de ")), (1 + F.col("turn") % 4).cast("int"))
    asked = c.select(F.concat_ws("-", "conv_id", "turn").alias("qid"), F.concat(lead, F.coalesce("text", F.lit(""))).alias("question"), (F.col("conv_id") + F.col("turn")).alias("vec_id"))
    return asked.join(table(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id", "left").drop("vec_id")


@query(f"WITH {_MANY} SELECT qid, chunk_id, place::INT AS place, round(rank_score, 6) AS rank_score, retrieval_method, relationships FROM top WHERE place <= 6")
def smart_search_many(spark, d):
    """Every turn of every fiftieth conversation as a question, each by its own strategy, in one plan."""
    c = passages(spark, d)
    found = questions.answered(_questions(spark, d), c, structure.chunk_edges(c), 6)
    return found.select("qid", "chunk_id", "place", F.round("rank_score", 6).alias("rank_score"), "retrieval_method", "relationships")


@query(f"""WITH {_MANY}, m AS (SELECT qid, avg(distance) AS mean, count(*) AS n FROM top WHERE place <= 6 GROUP BY qid), c AS (SELECT qid, kind, mean, coalesce(n, 0) AS n, coalesce(greatest(0.0, least(1.0, 1 - mean)), 0) AS confidence FROM q LEFT JOIN m USING (qid))
  SELECT qid, round(confidence, 6)::DOUBLE AS confidence, CASE WHEN n = 0 OR confidence < 0.55 THEN 'degraded' ELSE 'ok' END AS status,
  CASE WHEN n = 0 OR confidence < 0.55 THEN list_concat(['rephrase_question'], CASE WHEN coalesce(mean, 1) > 0.55 THEN ['add_entities'] ELSE [] END, CASE WHEN kind IN ('categorical', 'graph') THEN ['narrow_with_tag'] ELSE [] END) END AS advice FROM c""")
def smart_status_many(spark, d):
    """Confidence, status and advice of each of those questions."""
    c, asked = passages(spark, d), _questions(spark, d)
    found = questions.answered(asked, c, structure.chunk_edges(c), 6)
    return questions.statuses(asked, found).withColumn("confidence", F.round("confidence", 6))


@query(f"""WITH {_MANY}, both_of AS (SELECT qid, kind, chunk_id, round(list_cosine_distance(a, embedding::DOUBLE[]), 9) AS distance, list_has_any(flatten(list_transform(tags, lambda t: string_split(t, '/'))), entities) AS shared FROM q JOIN chunks ON a IS NOT NULL),
  r_near AS (SELECT * FROM both_of WHERE kind <> 'categorical' QUALIFY row_number() OVER (PARTITION BY qid ORDER BY distance, chunk_id) <= CASE kind WHEN 'graph' THEN 3 WHEN 'specific' THEN 4 ELSE 6 END),
  r_tagged AS (SELECT * FROM both_of WHERE kind = 'categorical' AND shared QUALIFY row_number() OVER (PARTITION BY qid ORDER BY distance, chunk_id) <= 6),
  r_all AS (SELECT qid, chunk_id, distance FROM r_near UNION ALL SELECT qid, dst, 0.5 FROM r_near JOIN beside ON src = chunk_id WHERE kind = 'graph' AND n <= 2 UNION ALL SELECT qid, chunk_id, distance FROM r_tagged)
  SELECT qid, chunk_id, round(min(distance), 6)::DOUBLE AS distance FROM r_all GROUP BY qid, chunk_id QUALIFY row_number() OVER (PARTITION BY qid ORDER BY min(distance), chunk_id) <= 6""")
def retrieve_many(spark, d):
    """Retrieval by intent for those questions; a chunk's tags are the parts of its tag paths."""
    c = passages(spark, d)
    parted = c.withColumn("tags", F.flatten(F.transform("tags", lambda t: F.split(t, "/"))))
    return questions.retrieved(_questions(spark, d), parted, structure.chunk_edges(c), 6).withColumn("distance", F.round("distance", 6))


# --- time ---------------------------------------------------------------------------------------

for _name, _phrase, _sql in (
    ("time_filter_last", "in the last 3 days", "ts >= TIMESTAMP '2024-01-17 12:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00'"),
    ("time_filter_week", "created last week", "ts >= TIMESTAMP '2024-01-08' AND ts <= TIMESTAMP '2024-01-15'"),
    ("time_filter_month", "this month", "ts >= TIMESTAMP '2024-01-01' AND ts <= TIMESTAMP '2024-01-20 12:00:00'"),
    ("time_filter_between", "between 2024-01-05 and 01/07/2024", "ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-07'"),
    ("time_filter_before", "modified before 2024-01-03", "ts < TIMESTAMP '2024-01-03'"),
):

    @query(f"SELECT event_id, event_type FROM events WHERE {_sql}", name=_name)
    def _time(spark, d, phrase=_phrase):
        return table(spark, d, "events").filter(timerange.within(timerange.parse_range(phrase, NOW), F.col("ts"), F.col("ts"))).select("event_id", "event_type")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-02-29' AND o_orderdate <= TIMESTAMP '1996-05-31'")
def time_filter_structured(spark, d):
    r = timerange.structured_range({"last": 3, "unit": "months", "mode": "both"}, datetime(1996, 5, 31, tzinfo=timezone.utc))
    return table(spark, d, "orders").filter(timerange.within(r, F.col("o_orderdate"), F.lit(None).cast("timestamp"))).select("o_orderkey")


@query("SELECT user_id::VARCHAR AS note_id, count(*) AS chunk_count FROM events WHERE ts >= TIMESTAMP '2024-01-18 12:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY user_id ORDER BY note_id LIMIT 50")
def list_notes_time(spark, d):
    e = table(spark, d, "events").filter(timerange.within(timerange.parse_range("past 2 days", NOW), F.col("ts"), F.col("ts")))
    return e.groupBy(F.col("user_id").cast("string").alias("note_id")).agg(F.count(F.lit(1)).alias("chunk_count")).orderBy("note_id").limit(50)


# --- classes and evaluation ---------------------------------------------------------------------


@query(f"WITH {NOTES} SELECT class, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4)::DOUBLE AS percent FROM (SELECT CASE quality WHEN 1 THEN 'area' WHEN 0 THEN 'archive' END AS class FROM notes) WHERE class IS NOT NULL GROUP BY class")
def para_distribution(spark, d):
    return stats.class_distribution(notes(spark, d).withColumn("para_type", F.when(F.col("quality") == 1, "area").when(F.col("quality") == 0, "archive")))


@query(f"WITH {NOTES} SELECT count(*) AS total, count(*) FILTER (quality IS NOT NULL OR len(tags) > 0) AS with_metadata, count(quality) AS with_type, count(*) FILTER (len(tags) > 0) AS with_tags, count(*) - count(quality) AS remaining FROM notes")
def taxonomy_analyze(spark, d):
    return stats.taxonomy(notes(spark, d).withColumn("para_type", F.col("quality").cast("string")))


@query("SELECT source AS folder, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, folder LIMIT 10")
def taxonomy_folders(spark, d):
    return stats.top_folders(notes(spark, d).withColumn("path", F.col("note_id")))


@query(f"WITH {NOTES} SELECT note_id, list_sort(list_distinct(list_concat(tags, CASE WHEN quality IS NULL THEN [] ELSE ['para/area', 'para/area/' || lower(source)] END))) AS tags FROM notes")
def enrich_merge(spark, d):
    n = notes(spark, d)
    return n.select("note_id", mutations.enrich_tags(F.col("tags"), F.when(F.col("quality").isNotNull(), "area"), F.col("source")).alias("tags"))


_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '\\s+'), lambda x: x <> ''))"
_PAIRS = f"pairs AS (SELECT item_id, {_WORDS.format(c='b.text')} AS q, {_WORDS.format(c='d.text')} AS c, d.text AS answer FROM benchmark b JOIN documents d ON d.doc_id = b.item_id)"


def _pairs(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("question"))
    return b.join(table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("answer")), "item_id")


_F1 = "coalesce(2.0 * len(list_intersect(c, q)) / nullif(len(c) + len(q), 0), 0)"


@query(f"WITH {_PAIRS} SELECT item_id, round(least(1.0, {_F1} + coalesce(least(len(list_intersect(q, c)) / nullif(len(q), 0)::DOUBLE * 0.2, 0.2), 0)), 6)::DOUBLE AS score FROM pairs")
def eval_f1(spark, d):
    return _pairs(spark, d).select("item_id", F.round(scoring.f1_with_context(F.col("answer"), F.col("question"), F.col("question"), F.col("answer")), 6).alias("score"))


@query(f"WITH {_PAIRS} SELECT item_id, round(coalesce(len(list_intersect(q, c)) / nullif(len(list_distinct(list_concat(q, c))), 0)::DOUBLE, 0), 6) AS score FROM pairs")
def eval_jaccard(spark, d):
    return _pairs(spark, d).select("item_id", F.round(scoring.word_jaccard(F.col("question"), F.col("answer")), 6).alias("score"))


@query(f"""WITH {_PAIRS}, s AS (SELECT item_id, {_F1} AS f, coalesce(len(list_intersect(q, c)) / nullif(len(list_distinct(list_concat(q, c))), 0)::DOUBLE, 0) AS j,
  CASE WHEN coalesce(length(answer), 0) = 0 THEN 0 ELSE least(1.0, least(1.0, len(list_filter(regexp_split_to_array(answer, '\\s+'), lambda x: x <> '')) / 50.0) + CASE WHEN regexp_matches(answer, '[.:\\-*]') THEN 0.2 ELSE 0 END) END AS m FROM pairs)
  SELECT item_id, round((f * 0.4 + 1.0 * 0.2 + j * 0.2 + m * 0.2)::DOUBLE, 6) AS score FROM s""")
def eval_composite(spark, d):
    p = _pairs(spark, d)
    cited = scoring.citation_quality(F.array(F.lit("a citation of some length")))
    return p.select("item_id", F.round(scoring.composite(scoring.word_f1(F.col("answer"), F.col("question")), cited, scoring.word_jaccard(F.col("question"), F.col("answer")), scoring.completeness(F.col("answer"))), 6).alias("score"))


@query("SELECT event_type AS operation, count(*) AS runs, round(avg(value), 6) AS avg_latency, round(avg(user_id), 6) AS avg_results, round(avg(value / 100), 6) AS avg_relevance, count(DISTINCT props) AS strategies, round(avg((value > 10)::INT), 6) AS success_rate FROM events GROUP BY 1")
def eval_summary(spark, d):
    return stats.eval_summary(table(spark, d, "events").select(F.col("event_type").alias("operation"), F.col("value").alias("latency"), F.col("user_id").alias("results"), (F.col("value") / 100).alias("relevance"), F.col("props").alias("strategy"), (F.col("value") > 10).alias("ok")))


@query(f"WITH {TURNS} SELECT chunk_id, 'What does ' || header_text || ' say?' AS question, 'specific' AS expected_intent FROM chunks WHERE header_text <> ''")
def eval_examples(spark, d):
    return turns(spark, d).filter("header_text <> ''").select("chunk_id", F.concat(F.lit("What does "), "header_text", F.lit(" say?")).alias("question"), F.lit("specific").alias("expected_intent"))


_WAY = "(concat('0x', substr(md5(key), 1, 8))::BIGINT % 4)::INT + 1"


@query(f"""WITH {TURNS}, {NOTE_TAGS.replace("notes AS", "doc_notes AS", 1).replace("FROM notes)", "FROM doc_notes)")},
  n AS (SELECT DISTINCT note_id, replace(note_id, 'conv-', 'conversation ') AS title FROM chunks), first AS (SELECT note_id, min(chunk_id) AS chunk_id FROM chunks GROUP BY note_id),
  e AS (SELECT a.note_id AS src, b.note_id AS dst FROM n a JOIN n b ON b.note_id = 'conv-' || (split_part(a.note_id, '-', 2)::BIGINT * 2 + 1)),
  header AS (SELECT chunk_id AS key, header_text AS a, lower(header_text) AS l, chunk_id FROM chunks WHERE header_text <> '' ORDER BY chunk_id LIMIT 20),
  link AS (SELECT src || '>' || dst AS key, x.title AS a, y.title AS b, f.chunk_id FROM (SELECT * FROM e WHERE src <> dst ORDER BY src, dst LIMIT 20) JOIN n x ON x.note_id = src JOIN n y ON y.note_id = dst LEFT JOIN first f ON f.note_id = src),
  tag AS (SELECT tag AS key, f.chunk_id FROM (SELECT tag, min(note_id) AS note_id FROM note_tags GROUP BY tag ORDER BY tag LIMIT 20) t LEFT JOIN first f USING (note_id)),
  factual AS (SELECT n.note_id AS key, title, f.chunk_id FROM (SELECT * FROM n ORDER BY note_id LIMIT 20) n LEFT JOIN first f USING (note_id))
  SELECT 'header' AS kind, key, ['What is ' || l || '?', 'Tell me about ' || l, 'Explain ' || l, 'What does the section on ' || l || ' cover?'][{_WAY}] AS question, 'Information about ' || a AS ideal_answer, 'semantic' AS expected_intent, chunk_id FROM header
  UNION ALL SELECT 'link', key, ['How is ' || a || ' related to ' || b || '?', 'What is the connection between ' || a || ' and ' || b || '?', 'Show me the relationship between ' || a || ' and ' || b, 'What links ' || a || ' to ' || b || '?'][{_WAY}], 'Relationship between ' || a || ' and ' || b, 'graph', chunk_id FROM link
  UNION ALL SELECT 'tag', key, ['What notes are tagged with #' || key || '?', 'Show me everything tagged #' || key, 'Find notes with tag ' || key, 'What content is categorized as ' || key || '?'][{_WAY}], 'Notes and content tagged with ' || key, 'categorical', chunk_id FROM tag
  UNION ALL SELECT 'factual', key, ['What specific information is in ' || title || '?', 'What are the key points from ' || title || '?', 'Summarize the main ideas in ' || title, 'What details does ' || title || ' provide?'][{_WAY}], 'Specific information from ' || title, 'specific', chunk_id FROM factual""")
def eval_example_kinds(spark, d):
    """Questions of four kinds (concepts, which SQL has no look-behind for, are tested apart), twenty of each."""
    c = turns(spark, d)
    n = c.select("note_id").distinct().withColumn("title", F.replace("note_id", F.lit("conv-"), F.lit("conversation ")))
    other = F.concat(F.lit("conv-"), (F.split_part("note_id", F.lit("-"), F.lit(2)).cast("long") * 2 + 1).cast("string"))
    e = n.select(F.col("note_id").alias("src"), other.alias("dst")).join(n.select(F.col("note_id").alias("dst")), "dst", "left_semi")
    return examples.examples(c, n, e, note_ops.note_tags(notes(spark, d)), 20, ("header", "link", "tag", "factual"))


# --- an index that is changed note by note --------------------------------------------------------

#: Documents as notes that link to two others, in other letters.
_LINKED_NOTES = "docs AS (SELECT doc_id, source || '/doc-' || doc_id || '.md' AS note_id, 'doc-' || doc_id AS name, ['DOC-' || (doc_id * 7 % 1009), 'doc-' || (doc_id + 1)] AS links FROM documents)"


def _kept_index(spark, d):
    n = notes(spark, d).select("doc_id", "note_id", "title", "stem", F.coalesce("text", F.lit("")).alias("text"), "tags")
    doc = F.col("doc_id")
    n = n.withColumn("links", F.array(F.concat(F.lit("DOC-"), (doc * 7 % 1009).cast("string")), F.concat(F.lit("doc-"), (doc + 1).cast("string"))))
    chunks = tables.written(index.chunked(n), "chunks")
    kept = index.store(spark, tables.scratch(spark, "index"), 16)
    index.put(kept, index.Index(n, note_ops.note_tags(n), note_ops.resolve_links(n), chunks, structure.chunk_edges(chunks)))
    return kept


@query(f"""WITH {_LINKED_NOTES}, moved AS (SELECT *, CASE WHEN doc_id % 50 = 0 THEN 'Archive/doc-' || doc_id || '.md' ELSE note_id END AS now FROM docs)
  SELECT s.now AS src, (i - 1)::INT AS ord, t.now AS dst FROM moved s, unnest([1, 2]) u(i) JOIN moved t ON lower(s.links[i]) = t.name""")
def archive_index(spark, d):
    """Links after every fiftieth note has moved to the archive: all name notes where they are now."""
    kept = _kept_index(spark, d)
    index.archive(kept, notes(spark, d).filter("doc_id % 50 = 0").select("note_id"))
    return index.get(kept).edges.select("src", "ord", "dst")


@query(f"""WITH {_LINKED_NOTES}, now AS (SELECT doc_id, note_id, links, CASE WHEN doc_id % 50 = 1 THEN 'doc-' || (doc_id + 1) ELSE name END AS name FROM docs WHERE doc_id % 50 <> 2),
  keys AS (SELECT name, min(note_id) AS dst FROM now GROUP BY name)
  SELECT note_id AS src, (i - 1)::INT AS ord, dst FROM now, unnest([1, 2]) u(i) JOIN keys ON lower(links[i]) = keys.name""")
def refresh_index(spark, d):
    """Links after some notes were deleted and others took their names, in one version."""
    kept = _kept_index(spark, d)
    old = kept.read("notes")
    named = F.concat(F.lit("doc-"), (F.col("doc_id") + 1).cast("string"))
    index.refresh(kept, old.filter("doc_id % 50 = 1").withColumns({"title": named, "stem": named}), old.filter("doc_id % 50 = 2").select("note_id"))
    return index.get(kept).edges.select("src", "ord", "dst")


def _class_by_size(texts):
    """A stand-in for a model: refuses short texts."""
    if any(len(t) < 100 for t in texts):
        raise ValueError("too short")
    return ["project" if len(t) % 2 else "area" for t in texts]


@query(r"""SELECT doc_id::VARCHAR AS note_id, CASE WHEN length(text) >= 100 THEN CASE WHEN length(text) % 2 = 1 THEN 'project' ELSE 'area' END END AS class, CASE WHEN length(text) >= 100 THEN 1 ELSE 2 END AS attempts
  FROM documents WHERE regexp_replace(text, '^\s+|\s+$', '', 'g') <> ''""")
def enrichment_state(spark, d):
    """Every document classified in two runs, of which the second tries only what failed in the first."""
    state = rounds.enrichment(spark, tables.scratch(spark, "enrichment"), 8)
    n = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("note_id"), "text")
    for _ in range(2):
        rounds.enrich(n, state, _class_by_size, "by size", parts=2)
    return state.read("state").select("note_id", "class", "attempts")


# --- changes ------------------------------------------------------------------------------------


@query(f"WITH {TURNS} SELECT chunk_id, note_id, content FROM chunks WHERE note_id <> 'conv-3' UNION ALL SELECT 'conv-3/chunk_0', 'conv-3', 'new'")
def upsert_note(spark, d):
    fresh = spark.createDataFrame([("conv-3/chunk_0", "conv-3", "new")], "chunk_id string, note_id string, content string")
    return mutations.upsert_notes(turns(spark, d), fresh)


@query(f"WITH {TURNS} SELECT chunk_id, note_id FROM chunks WHERE note_id <> 'conv-3'")
def delete_note(spark, d):
    return mutations.delete_notes(turns(spark, d), spark.createDataFrame([("conv-3",)], "note_id string")).select("chunk_id", "note_id")


@query("SELECT doc_id, lang AS lang_value, 'done' AS status_value, 2 AS n FROM documents")
def update_properties(spark, d):
    m = mutations.merge_properties(F.create_map(F.lit("lang"), F.col("lang"), F.lit("status"), F.lit("open")), F.create_map(F.lit("status"), F.lit("done")))
    return table(spark, d, "documents").withColumn("m", m).select("doc_id", F.col("m")["lang"].alias("lang_value"), F.col("m")["status"].alias("status_value"), F.size("m").alias("n"))


@query("SELECT p_partkey, '00 Inbox/' || replace(p_name, '!', '') || '.md' AS path, ['b', 'a', 'para/area'] AS tags FROM part")
def create_note(spark, d):
    made = mutations.created_note(F.concat("p_name", F.lit("!")), F.lit(""), F.array(F.lit("#b"), F.lit("a"), F.lit("b")), para_type=F.lit("area"))
    return table(spark, d, "part").select("p_partkey", made["path"].alias("path"), made["tags"].alias("tags"))


@query("SELECT doc_id, 'Archive/doc-' || doc_id || '.md' AS path, text || chr(10) || chr(10) || lang AS text FROM documents")
def archive_note(spark, d):
    n = notes(spark, d)
    return n.select("doc_id", mutations.archived_path(F.col("note_id")).alias("path"), mutations.add_content(F.col("text"), F.col("vault")).alias("text"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def stream_upsert(spark, d):
    """Events as changes of users, read as a stream until it is exhausted; the table's last state."""
    e = table(spark, d, "events")
    stream = feed.changes(spark, d, e.schema, name="events.parquet").withColumn("changed_at", F.struct("ts", "event_id"))
    where = tables.scratch(spark, "stream")
    feed.upsert_stream(stream, f"{where}/table", f"{where}/state", "user_id")
    return feed.current(spark, f"{where}/table").select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AND event_type <> 'error'")
def stream_delete(spark, d):
    """The same with errors as deletions: a user whose last event is one is not in the table."""
    e = table(spark, d, "events")
    stream = feed.changes(spark, d, e.schema, name="events.parquet").withColumn("changed_at", F.struct("ts", "event_id")).withColumn("gone", F.col("event_type") == "error")
    where = tables.scratch(spark, "stream")
    feed.upsert_stream(stream, f"{where}/table", f"{where}/state", "user_id", gone="gone")
    return feed.current(spark, f"{where}/table").select("user_id", "event_id", "event_type")


@query("SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS start, time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOURS AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3")
def tumbling(spark, d):
    return feed.windowed(table(spark, d, "events"), "6 hours").withColumn("total", F.round("total", 4))


@query("SELECT s AS start, s + INTERVAL 12 HOURS AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 6 HOURS AS s FROM events, range(0, 2) r(k)) GROUP BY 1, 2, 3")
def sliding(spark, d):
    return feed.windowed(table(spark, d, "events"), "12 hours", "6 hours").withColumn("total", F.round("total", 4))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOURS AS "end", count(*) AS n FROM g GROUP BY user_id, s""")
def session(spark, d):
    return feed.sessions(table(spark, d, "events"), "2 hours")


# --- streams with late rows -----------------------------------------------------------------------

#: Parts in which the events arrive, one run of a stream each; every 50th event of the first part comes with the last.
PARTS = 4


def _parts(spark, d):
    """(parts of events in order of arrival)."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    span = e.agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    at = F.floor(PARTS * (F.unix_micros("ts") - F.unix_micros("a")) / (F.unix_micros("b") - F.unix_micros("a") + 1)).cast("int")
    part = F.when((at == 0) & (F.col("event_id") % 50 == 0), PARTS - 1).otherwise(at)
    return e.crossJoin(F.broadcast(span)).withColumn("part", part).drop("a", "b")  # the span is one row


def _streamed(spark, d, plan, again=()):
    """``plan`` over the events as they arrive: the stream stops and starts again after each part.

    ``again``: (remainder by 10, parts later) of events that come a second time.
    """
    events, where = _parts(spark, d), tables.scratch(spark, "stream")
    schema = events.drop("part").schema
    for k in range(PARTS):
        rows = events.filter(F.col("part") == k)
        for remainder, later in again:
            rows = rows.unionByName(events.filter((F.col("part") == k - later) & (F.col("event_id") % 10 == remainder)))
        rows.drop("part").write.mode("append").parquet(f"{where}/in")
        run.drained(plan(spark.readStream.schema(schema).parquet(f"{where}/in")), f"{where}/out", f"{where}/state")
    return spark.read.parquet(f"{where}/out")


#: What each part finds as the watermark: an hour behind all that came before.  ``final``: the one after all parts.
_ARRIVED = f"""span AS (SELECT epoch_us(min(ts)) AS a, epoch_us(max(ts)) AS b FROM events),
  parts AS (SELECT e.*, ({PARTS} * (epoch_us(ts) - a) // (b - a + 1))::INT AS slot FROM events e, span),
  arrived AS (SELECT *, CASE WHEN slot = 0 AND event_id % 50 = 0 THEN {PARTS - 1} ELSE slot END AS part FROM parts),
  marks AS (SELECT p.part, coalesce((SELECT max(date_trunc('milliseconds', ts)) FROM arrived q WHERE q.part < p.part) - INTERVAL 1 HOUR, TIMESTAMP '1970-01-01') AS mark FROM range(0, {PARTS + 1}) p(part)),
  final AS (SELECT max(mark) AS mark FROM marks WHERE part = {PARTS})"""


@query(f"""WITH {_ARRIVED}, w AS (SELECT *, time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS start FROM arrived)
  SELECT start, start + INTERVAL 6 HOURS AS "end", event_type, count(*) AS n, round(sum(value), 4) AS total FROM w JOIN marks USING (part) WHERE start + INTERVAL 6 HOURS > mark
  GROUP BY 1, 2, 3 HAVING start + INTERVAL 6 HOURS <= (SELECT mark FROM final)""")
def stream_tumbling_late(spark, d):
    """Windows of a stream that is stopped and started again; rows behind the watermark do not count."""
    out = _streamed(spark, d, lambda s: feed.windowed(s, "6 hours"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", "n", F.round("total", 4).alias("total"))


@query(f"""WITH {_ARRIVED}, k AS (SELECT user_id, ts FROM arrived JOIN marks USING (part) WHERE ts + INTERVAL 2 HOURS > mark),
  e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS new FROM k WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM e)
  SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOURS AS "end", count(*) AS n FROM g GROUP BY user_id, s HAVING max(ts) + INTERVAL 2 HOURS <= (SELECT mark FROM final)""")
def stream_session_late(spark, d):
    """Sessions of a stream, across the parts in which it arrives."""
    out = _streamed(spark, d, lambda s: feed.sessions(s, "2 hours"))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query(f"WITH {_ARRIVED} SELECT event_id, user_id FROM arrived JOIN marks USING (part) WHERE ts > mark")
def stream_dedup(spark, d):
    """Events of which some come twice in a part or again in the next one; each counts once, late ones not at all."""
    return _streamed(spark, d, lambda s: feed.deduplicated(s, ["event_id"]), again=((3, 0), (4, 1))).select("event_id", "user_id")


@query(f"""WITH {_ARRIVED}, k AS (SELECT * FROM arrived JOIN marks USING (part) WHERE ts > mark),
  n AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM k)
  SELECT user_id, event_id, event_type FROM n WHERE (next IS NULL OR next - ts >= INTERVAL 3 HOURS) AND ts + INTERVAL 3 HOURS <= (SELECT mark FROM final)""")
def stream_debounced(spark, d):
    """Events as changes of users, each held until its user has been quiet for three hours."""
    return _streamed(spark, d, lambda s: debounced(s, "user_id", "ts", 3 * 3_600_000, "1 hour", "event_id")).select("user_id", "event_id", "event_type")


# --- further functions --------------------------------------------------------------------------


@query()
def pack_paragraphs(spark, d):
    """(doc_id, place, content): texts above the chunk limit split at natural boundaries."""
    text_ = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.posexplode(sections.split_large(text_)).alias("place", "content"))


@query(r"""SELECT conv_id, turn, regexp_matches(lower(text), 'how.*(?:relate|connect|influence|lead|cause)') OR regexp_matches(lower(text), 'what.*(?:relationship|connection|difference|similarity)')
  OR regexp_matches(lower(text), 'explain.*(?:why|how|relationship|connection)') OR regexp_matches(lower(text), 'compare.*(?:and|with|to|between)') OR regexp_matches(lower(text), 'trace.*(?:development|evolution|history|progression)')
  OR regexp_matches(lower(text), 'analyze.*(?:impact|effect|influence|relationship)') OR length(text) - length(replace(text, '?', '')) > 1 OR contains(lower(text), ' and ')
  OR len(list_filter(string_split(regexp_replace(regexp_replace(' ' || regexp_replace(text, '([\pL\pN_]+)', ' \1 ', 'g') || ' ', ' [A-Z][a-z]+ (?:\s*)', chr(1), 'g'), chr(1) || '+', chr(1), 'g'), chr(1)), lambda x: true)) > 3 AS agent FROM conversations""")
def wants_agent(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", intents.wants_agent(F.col("text")).alias("agent"))


@query(r"""WITH c AS (SELECT doc_id, unnest(list_distinct(regexp_split_to_array(coalesce(text, ''), '[^\pL\pN_]+'))) AS w FROM documents)
  SELECT doc_id, count(*) AS capitals FROM c WHERE regexp_full_match(w, '[A-Z][a-z]{3,}') GROUP BY doc_id""")
def capitalised_words(spark, d):
    """Distinct capitalised words of more than three letters."""
    words = F.split(F.coalesce("text", F.lit("")), r"[^\p{L}\p{N}_]+")
    n = F.size(F.array_distinct(F.filter(words, lambda w: w.rlike("^[A-Z][a-z]{3,}$")))).cast("long")
    return table(spark, d, "documents").select("doc_id", n.alias("capitals")).filter("capitals > 0")


@query(r"""SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[\n,]'), lambda x: regexp_replace(regexp_replace(x, '[#''"]', '', 'g'), '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS parts FROM documents""")
def split_tags(spark, d):
    return table(spark, d, "documents").select("doc_id", text.split_tags(F.col("text")).alias("parts"))


@query("SELECT p_partkey, regexp_replace(replace(lower(p_name), ' ', '-'), '[^a-z0-9-]', '', 'g') AS slug, p_name AS title FROM part")
def slugs(spark, d):
    return table(spark, d, "part").select("p_partkey", text.slug(F.col("p_name")).alias("slug"), text.safe_title(F.col("p_name")).alias("title"))


@query("SELECT doc_id, list_has_any(string_split(source || '/' || lang, '/'), ['src3', 'de']) AS protected FROM documents")
def protected_paths(spark, d):
    return table(spark, d, "documents").select("doc_id", text.protected_path(F.concat_ws("/", "source", "lang"), ("src3", "de")).alias("protected"))


@query(f"WITH {TURNS}, {EDGES} SELECT src, dst, rel, row_number() OVER (PARTITION BY src ORDER BY ord, dst)::INT AS place FROM edges QUALIFY row_number() OVER (PARTITION BY src ORDER BY ord, dst) <= 3")
def first_neighbors(spark, d):
    c = turns(spark, d)
    return graph.first_neighbors(graph.steps(structure.chunk_edges(c), per_class=3), 3).select("src", "dst", "rel", "place")


@query()
def engine_search(spark, d):
    """One question through the whole engine: routed, expanded, hydrated, ranked."""
    from noteloom.operators.engine import Engine

    c = passages(spark, d)
    return Engine(c, structure.chunk_edges(c)).smart_search("what links to src3?", 6).hits.select("chunk_id", "rank_score", "retrieval_method")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
