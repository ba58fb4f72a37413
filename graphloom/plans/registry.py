"""The library's registered queries and DuckDB SQL for the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import encode, text
from graphloom.operators import chunker, extraction, graph, many, rank, vector
from graphloom.plans import context, indexing, retrieval
from graphloom.sources import index as indexes
from graphloom.sources import hybrid as hybrids
from graphloom.sources import order, snapshot, star
from graphloom.sources.shared import PACKED, fresh, shared_folder

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


ENTITIES = """entities AS (
  SELECT r_name AS id, 'region' AS entity_type, '' AS entity_role FROM region UNION ALL SELECT n_name, 'nation', '' FROM nation
  UNION ALL SELECT c_name, 'customer', c_mktsegment FROM customer UNION ALL SELECT s_name, 'supplier', '' FROM supplier
  UNION ALL SELECT p_name || ' ' || p_partkey, 'part', p_type FROM part)"""
EDGES = """edges AS (
  SELECT n_name AS source, r_name AS target, 'IN_REGION' AS rel_type FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT c_name, n_name, 'LIVES_IN' FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT s_name, n_name, 'BASED_IN' FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT s_name, p_name || ' ' || p_partkey, 'SUPPLIES' FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)"""
BOTH = """two AS (SELECT source AS s, target AS t, rel_type AS relationship FROM edges UNION ALL SELECT target, source, rel_type FROM edges WHERE source <> target),
x AS (SELECT a.id AS source_id, a.entity_role AS source_role, 'Entity' AS source_type, relationship, b.id AS target_id, b.entity_role AS target_role, 'Entity' AS target_type
      FROM two JOIN entities a ON s = a.id JOIN entities b ON t = b.id)"""
GRAPH = f"WITH {ENTITIES}, {EDGES}"
TARGETS, EXCLUDED = ["region_1", "NATION_3", "building"], ["NATION_8", "machinery"]


def _low(xs: list[str]) -> str:
    return "(" + ", ".join(f"'{x.lower()}'" for x in xs) + ")"


def _search_sql(condition: str, excluded: list[str] = [], limit: int = 10) -> str:  # noqa: B006
    out = "".join(f" AND lower({c}) NOT IN {_low(excluded)}" for c in ("source_id", "source_role", "target_id", "target_role")) if excluded else ""
    return f"{GRAPH}, {BOTH} SELECT DISTINCT * FROM x WHERE ({condition}){out} ORDER BY source_id, relationship, target_id LIMIT {limit}"


EXACT = f"lower(source_id) IN {_low(TARGETS)} OR lower(source_role) IN {_low(TARGETS)}"


def ents(spark: SparkSession, d: str) -> DataFrame:
    return star.entities(spark, d)


@query("entity_scan", f"{GRAPH} SELECT id, 'Entity;' || upper(entity_type) AS labels, entity_type, entity_role FROM entities ORDER BY id")
def _(spark, d):
    return ents(spark, d).select("id", F.concat_ws(";", "labels").alias("labels"), "entity_type", "entity_role").orderBy("id")


@query("edge_scan", f"{GRAPH} SELECT source, target, rel_type FROM edges WHERE source IN (SELECT id FROM entities) AND target IN (SELECT id FROM entities) ORDER BY ALL")
def _(spark, d):
    tasks, order_by = star.edge_tasks(spark, d), ["source", "target", "rel_type"]
    found = graph.between(star.edges(spark, d), ents(spark, d), tasks)
    return found.repartitionByRange(tasks, *order_by).sortWithinPartitions(*order_by) if tasks else found.orderBy(*order_by)


@query("entity_page", f"{GRAPH} SELECT id FROM entities ORDER BY id LIMIT 50 OFFSET 100")
def _(spark, d):
    return ents(spark, d).select("id").orderBy("id").offset(100).limit(50)


@query("entity_page_keyset", f"{GRAPH} SELECT id, entity_type FROM entities ORDER BY id LIMIT 50 OFFSET 100")
def _(spark, d):
    """The third page of the stored order, each page by the last key of the one before."""
    ordered = order.arrange(ents(spark, d).select("id", "entity_type"), ["id"], fresh(spark, "entities"))
    after = None
    for _ in range(2):
        after = (ordered.page(after, 50).agg(F.max("id")).first()[0],)
    return ordered.page(after, 50)


@query("edge_page_at", f"{GRAPH} SELECT source, target, rel_type FROM edges ORDER BY source, target, rel_type LIMIT 100 OFFSET 1000")
def _(spark, d):
    """A page by its place, from the files it lies in."""
    return order.arrange(star.edges(spark, d), ["source", "target", "rel_type"], fresh(spark, "edges")).page_at(1000, 100)


@query("unique_id_check", f"{GRAPH} SELECT count(*) AS n_rows, count(DISTINCT id) AS n_ids FROM entities")
def _(spark, d):
    return ents(spark, d).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("id").alias("n_ids"))


@query("graph_stats", f"{GRAPH} SELECT (SELECT count(*) FROM entities) AS n_entities, (SELECT count(*) FROM edges) AS n_relationships, (SELECT count(*) FROM documents) AS n_chunks")
def _(spark, d):
    parts = {"n_entities": ents(spark, d), "n_relationships": star.edges(spark, d), "n_chunks": star.table(spark, d, "documents")}
    rows = [df.agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit(k)) for k, df in parts.items()]
    every = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return every.agg(*[F.max(F.when(F.col("what") == k, F.col("n"))).alias(k) for k in parts])


@query("edge_type_counts", f"{GRAPH} SELECT rel_type, count(*) AS n FROM edges GROUP BY rel_type")
def _(spark, d):
    return star.edges(spark, d).groupBy("rel_type").agg(F.count(F.lit(1)).alias("n"))


@query("graph_exact", _search_sql(EXACT, limit=50))
def graph_exact(spark, d):
    return graph.exact(ents(spark, d), star.edges(spark, d), TARGETS, limit=50)


@query("graph_exact_excluded", _search_sql(EXACT, EXCLUDED, 50))
def _(spark, d):
    return graph.exact(ents(spark, d), star.edges(spark, d), TARGETS, EXCLUDED, 50)


@query("graph_expand", f"{GRAPH}, {BOTH} SELECT source_id, relationship, count(*) AS n FROM x GROUP BY ALL")
def _(spark, d):
    e = ents(spark, d)
    return graph.expand(e, e, star.edges(spark, d), star.edge_tasks(spark, d)).groupBy("source_id", "relationship").agg(F.count(F.lit(1)).alias("n"))


@query("graph_contains", _search_sql("contains(lower(source_id), 'ation_1') OR contains(lower(source_role), 'ation_1')", limit=50))
def _(spark, d):
    return graph.contains(ents(spark, d), star.edges(spark, d), ["ATION_1"], limit=50)


def _fuzzy_sql(names: list[str], limit: int) -> str:
    score = lambda n: f"list_max(list_transform(string_split_regex(lower(id), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: CASE WHEN starts_with(t, '{n}') THEN 1.0 WHEN damerau_levenshtein(t, '{n}') <= 1 THEN 1.0 - 1.0 / {len(n)} ELSE 0.0 END))"
    hits = " UNION ALL ".join(f"SELECT id, {i} AS n, CAST({score(n.lower())} AS DOUBLE) AS score FROM entities" for i, n in enumerate(names))
    return f"""{GRAPH}, {BOTH}, h AS ({hits}), f AS (SELECT DISTINCT x.*, n, score FROM x JOIN h ON source_id = id WHERE score >= 0.5),
k AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, source_id, relationship, target_id) AS k FROM f),
o AS (SELECT *, row_number() OVER (PARTITION BY source_id, relationship, target_id ORDER BY n, k) AS o FROM k WHERE k <= {limit})
SELECT source_id, source_role, source_type, relationship, target_id, target_role, target_type, score FROM o WHERE o = 1 ORDER BY n, k LIMIT {limit}"""


@query("graph_fuzzy", _fuzzy_sql(["NATON_1", "REGOIN_2"], 20))
def _(spark, d):
    return graph.fuzzy(ents(spark, d), star.edges(spark, d), ["NATON_1", "REGOIN_2"], limit=20)


def _cascade_sql(names: list[str], limit: int) -> str:
    """The three legs, each only where those before it find nothing."""
    low = _low(names)
    hit = " OR ".join(f"contains(lower({c}), '{n.lower()}')" for n in names for c in ("source_id", "source_role"))
    fuzzy_part = _fuzzy_sql(names, limit)
    head, tail = fuzzy_part.rsplit("\nSELECT source_id", 1)
    fuzzy_rows = "SELECT source_id" + tail.replace(", score FROM o", " FROM o")
    order = "ORDER BY source_id, relationship, target_id"
    return f"""{head}, one AS (SELECT DISTINCT * FROM x WHERE lower(source_id) IN {low} OR lower(source_role) IN {low} {order} LIMIT {limit}),
two_ AS ({fuzzy_rows}), three AS (SELECT DISTINCT * FROM x WHERE {hit} {order} LIMIT {limit})
SELECT * FROM one UNION ALL SELECT * FROM two_ WHERE NOT EXISTS (SELECT 1 FROM one) UNION ALL SELECT * FROM three WHERE NOT EXISTS (SELECT 1 FROM one) AND NOT EXISTS (SELECT 1 FROM two_)"""


for _name, _names in {"graph_cascade": ["ation_1"], "graph_cascade_exact": ["nation_3", "building"], "graph_cascade_fuzzy": ["NATON_1", "REGOIN_2"], "graph_cascade_contains": ["omer#00000000"]}.items():
    query(_name, _cascade_sql(_names, 20))(lambda spark, d, names=_names: graph.cascade(ents(spark, d), star.edges(spark, d), names, limit=20))


@query("token_index", f"{GRAPH} SELECT token, length(token) AS length, id FROM (SELECT DISTINCT id, unnest(string_split_regex(lower(id), '[^\\p{{L}}\\p{{N}}_]+')) AS token FROM entities) WHERE token <> ''")
def _(spark, d):
    return graph.token_index(ents(spark, d))


@query("graph_fuzzy_indexed", _fuzzy_sql(["NATON_1", "REGOIN_2"], 20))
def _(spark, d):
    """Fuzzy search through the stored token index."""
    path = fresh(spark, "tokens")
    indexes.save_tokens(ents(spark, d), path)
    return graph.fuzzy(ents(spark, d), star.edges(spark, d), ["NATON_1", "REGOIN_2"], limit=20, tokens=indexes.load_tokens(spark, path))


@query("token_keys", f"""{GRAPH}, t AS (SELECT DISTINCT unnest(string_split_regex(lower(id), '[^\\p{{L}}\\p{{N}}_]+')) AS token FROM entities),
w AS (SELECT token, unnest(range(0, length(token) + 1)) AS i FROM t WHERE token <> '')
SELECT DISTINCT CASE i WHEN 0 THEN token ELSE left(token, i - 1) || substr(token, i + 1) END AS key, token FROM w""")
def _(spark, d):
    return graph.deletion_keys(graph.token_index(ents(spark, d)))


@query("viz_edges", f"{GRAPH} SELECT source, rel_type, target, a.entity_type AS source_type, b.entity_type AS target_type FROM edges JOIN entities a ON source = a.id JOIN entities b ON target = b.id ORDER BY source, rel_type, target LIMIT 100")
def _(spark, d):
    e = ents(spark, d)
    a, b = e.select(F.col("id").alias("source"), F.col("entity_type").alias("source_type")), e.select(F.col("id").alias("target"), F.col("entity_type").alias("target_type"))
    return star.edges(spark, d).join(a, "source").join(b, "target").select("source", "rel_type", "target", "source_type", "target_type").orderBy("source", "rel_type", "target").limit(100)


def _mod(m: int) -> str:
    return f"list_reduce(list_transform(string_split(md5(kind), ''), lambda c: instr('0123456789abcdef', c) - 1), lambda a, b: (a * 16 + b) % {m}, 0)"


COLOR_SQL = f"""{GRAPH}, k AS (SELECT DISTINCT entity_type AS kind FROM entities), m AS (SELECT kind, {_mod(360)} AS h, (60 + {_mod(20)}) / 100.0::DOUBLE AS s, (45 + {_mod(20)}) / 100.0::DOUBLE AS l FROM k),
c AS (SELECT *, (1 - abs(2 * l - 1)) * s AS c, h // 60 AS q FROM m), x AS (SELECT *, c * (1 - abs((h / 60.0::DOUBLE) % 2 - 1)) AS x, l - c / 2 AS w FROM c),
p AS (SELECT kind, CASE q WHEN 0 THEN c WHEN 1 THEN x WHEN 4 THEN x WHEN 5 THEN c ELSE 0 END + w AS r, CASE q WHEN 0 THEN x WHEN 1 THEN c WHEN 2 THEN c WHEN 3 THEN x ELSE 0 END + w AS g, CASE q WHEN 2 THEN x WHEN 3 THEN c WHEN 4 THEN c WHEN 5 THEN x ELSE 0 END + w AS b FROM x)
SELECT kind, printf('#%02X%02X%02X', CAST(floor(r * 255) AS INT), CAST(floor(g * 255) AS INT), CAST(floor(b * 255) AS INT)) AS color FROM p"""


@query("category_color", COLOR_SQL)
def _(spark, d):
    return ents(spark, d).select(F.col("entity_type").alias("kind")).distinct().select("kind", text.color_of(F.col("kind")).alias("color"))


@query("viz_nodes", f"""{GRAPH} SELECT id, CASE WHEN length(id) > 12 THEN left(id, 12) || '...' ELSE id END AS label,
  id || '<br>Type: ' || entity_type || CASE WHEN entity_role = '' THEN '' ELSE '<br>Role: ' || entity_role END AS hover FROM entities""")
def _(spark, d):
    return ents(spark, d).select("id", text.short_label(F.col("id"), 12).alias("label"), text.hover_text(F.col("id"), F.col("entity_type"), F.col("entity_role")).alias("hover"))


NOISY = """noisy AS (SELECT c_custkey AS seq, CASE c_custkey % 8 WHEN 0 THEN '1. ' || n_name WHEN 1 THEN '- ' || n_name || ' (remark)' WHEN 2 THEN ' "' || n_name || '" ' WHEN 3 THEN n_name || '...'
  WHEN 4 THEN '(a) * ' || n_name WHEN 5 THEN '#' || n_name || '_% (his home)' WHEN 6 THEN '12) [' || n_name || '] .....' ELSE '  + {' || n_name || '}' END AS id,
  CASE c_custkey % 3 WHEN 0 THEN 'nation' WHEN 1 THEN 'home country' ELSE '' END AS entity_type, c_mktsegment AS entity_role FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def noisy(spark, d) -> DataFrame:
    n = star.table(spark, d, "customer").join(star.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k, around = F.col("c_custkey"), [("1. ", ""), ("- ", " (remark)"), (' "', '" '), ("", "..."), ("(a) * ", ""), ("#", "_% (his home)"), ("12) [", "] ....."), ("  + {", "}")]
    id_ = F.element_at(F.array(*[F.concat(F.lit(before), F.col("n_name"), F.lit(after)) for before, after in around]), (k % 8 + 1).cast("int"))
    return n.select(k.alias("seq"), id_.alias("id"), F.when(k % 3 == 0, "nation").when(k % 3 == 1, "home country").otherwise("").alias("entity_type"), F.col("c_mktsegment").alias("entity_role"))


def _cleaned_sql(x: str) -> str:
    """The cleaner's six steps: ends, list markers, a remark at the end, junk at the ends, dots, ends."""
    junk = r"""[\s_#$!@+\-*/()\[\]{}%"'']+"""
    x = rf"regexp_replace(trim({x}), '^\s*(\d+[.)]\s*|[*\-•+]\s*|\([a-zA-Z\d]+\)\s*)*', '')"
    return rf"trim(regexp_replace(regexp_replace(regexp_replace({x}, '\s+\([^)]*\)$', ''), '^{junk}|{junk}$', '', 'g'), '\s*\.{{3,}}$', ''))"


CLEAN = f"clean AS (SELECT seq, {_cleaned_sql('id')} AS id, entity_type, entity_role FROM noisy)"


@query("clean_names", f"WITH {NOISY}, {CLEAN} SELECT seq, id FROM clean")
def _(spark, d):
    return noisy(spark, d).select("seq", text.clean_name(F.col("id")).alias("id"))


@query("label_normalize", "SELECT DISTINCT p_type, upper(replace(replace(p_type, ' ', '_'), '-', '_')) AS label FROM part")
def _(spark, d):
    return star.table(spark, d, "part").select("p_type", text.label_of(F.col("p_type")).alias("label")).distinct()


@query("entity_dedup", f"WITH {NOISY} SELECT seq, id, entity_type, entity_role FROM (SELECT *, row_number() OVER (PARTITION BY trim(id), trim(entity_type), trim(entity_role) ORDER BY seq) AS k FROM noisy) WHERE k = 1")
def _(spark, d):
    return graph.dedup_entities(noisy(spark, d))


@query("node_upsert", f"""{GRAPH}, {NOISY}, {CLEAN}, n AS (SELECT id, entity_type, entity_role, seq, upper(replace(entity_type, ' ', '_')) AS label FROM clean WHERE entity_type <> ''
  UNION ALL SELECT id, entity_type, entity_role, -1, upper(entity_type) FROM entities)
SELECT id, arg_max(entity_type, seq) AS entity_type, arg_max(entity_role, seq) AS entity_role, 'Entity;' || string_agg(DISTINCT label, ';' ORDER BY label) AS labels FROM n GROUP BY id""")
def _(spark, d):
    return graph.upsert_nodes(ents(spark, d), graph.clean_entities(noisy(spark, d))).select("id", "entity_type", "entity_role", F.concat_ws(";", "labels").alias("labels"))


RAW_EDGES = """raw AS (SELECT o_orderkey AS seq, ' ' || c_name AS source, CASE o_orderkey % 5 WHEN 0 THEN 'nobody' WHEN 1 THEN ' ' || c_name ELSE n_name END AS target,
  CASE o_orderkey % 4 WHEN 0 THEN '-' WHEN 1 THEN 'ordered-from' ELSE 'lives in' END AS rel_type FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def raw_edges(spark, d) -> DataFrame:
    t = star.table(spark, d, "orders").join(star.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(star.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k, source = F.col("o_orderkey"), F.concat(F.lit(" "), F.col("c_name"))
    return t.select(k.alias("seq"), source.alias("source"), F.when(k % 5 == 0, "nobody").when(k % 5 == 1, source).otherwise(F.col("n_name")).alias("target"), F.when(k % 4 == 0, "-").when(k % 4 == 1, "ordered-from").otherwise("lives in").alias("rel_type"))


@query("edge_upsert", f"""{GRAPH}, {RAW_EDGES} SELECT * FROM edges UNION SELECT trim(source), trim(target), upper(replace(replace(rel_type, ' ', '_'), '-', '_')) FROM raw
  WHERE source <> target AND rel_type <> '-' AND trim(source) IN (SELECT id FROM entities) AND trim(target) IN (SELECT id FROM entities)""")
def _(spark, d):
    return graph.upsert_edges(star.edges(spark, d), raw_edges(spark, d), ents(spark, d))


@query("edge_dedup", f"WITH {RAW_EDGES} SELECT min(seq) AS seq, source, target, rel_type FROM raw GROUP BY source, target, rel_type")
def _(spark, d):
    return graph.dedup_edges(raw_edges(spark, d))


#: Payloads of which a part is lost, by the length of their id: JSON no more, so nothing is taken from them.
_BROKEN = "length({}) % 5 = 0"


def _chunks_of(rows: DataFrame) -> DataFrame:
    """Rows of id and payload as chunks, some payloads cut off."""
    cut = F.when(F.expr(_BROKEN.format("id")), F.left("payload", F.length("payload") - 2)).otherwise(F.col("payload"))
    return rows.select(F.lit(0).cast("long").alias("seq"), F.col("id").alias("content"), cut.alias("payload"))


@query("extraction_parse", f"{GRAPH} SELECT id, entity_type, coalesce(entity_role, '') AS entity_role FROM entities WHERE NOT {_BROKEN.format('id')}")
def _(spark, d):
    """A payload an entity; its role is left out of the JSON where there is none."""
    node = F.struct("id", "entity_type", F.expr("nullif(entity_role, '')").alias("entity_role"))
    rels = F.array().cast("array<struct<source:string,target:string,relationship_type:string>>")
    rows = ents(spark, d).select("id", F.to_json(F.struct(F.array(node).alias("nodes"), rels.alias("relationships"))).alias("payload"))
    return extraction.nodes(extraction.usable(_chunks_of(rows))).select(*extraction.NODE)


def payloads(spark, d) -> DataFrame:
    """Extraction payloads as a model gives them (M8), made from the star schema: for each id, every entity of it as a node
    and its outgoing edges as relationships; some are cut off."""
    e = ents(spark, d).select("id", F.struct("id", "entity_type", "entity_role").alias("node"), F.lit(None).cast("struct<source:string,target:string,relationship_type:string>").alias("rel"))
    r = star.edges(spark, d).select(F.col("source").alias("id"), F.lit(None).cast("struct<id:string,entity_type:string,entity_role:string>").alias("node"), F.struct("source", "target", F.col("rel_type").alias("relationship_type")).alias("rel"))
    return _chunks_of(e.unionByName(r).groupBy("id").agg(F.to_json(F.struct(F.collect_list("node").alias("nodes"), F.collect_list("rel").alias("relationships"))).alias("payload")))


@query("extraction_parse_nodes", f"{GRAPH} SELECT id, entity_type, entity_role FROM entities WHERE NOT {_BROKEN.format('id')}")
def _(spark, d):
    return extraction.nodes(extraction.usable(payloads(spark, d))).select(*extraction.NODE)


@query("extraction_parse_relationships", f"{GRAPH} SELECT source, target, rel_type AS relationship_type FROM edges WHERE NOT {_BROKEN.format('source')}")
def _(spark, d):
    return extraction.relationships(extraction.usable(payloads(spark, d))).select("source", "target", F.col("rel_type").alias("relationship_type"))


def _snapshot(spark, d) -> str:
    path = f"{shared_folder(spark)}/snapshot-{uuid.uuid4().hex}"
    snapshot.backup(ents(spark, d), star.edges(spark, d), path)
    return path


@query("backup_restore_nodes", f"{GRAPH} SELECT id, entity_type, entity_role, 'Entity;' || upper(entity_type) AS labels FROM entities")
def _(spark, d):
    return snapshot.restore_nodes(spark, _snapshot(spark, d)).select("id", "entity_type", "entity_role", F.concat_ws(";", "labels").alias("labels"))


@query("backup_restore_edges", f"{GRAPH} SELECT DISTINCT source, target, rel_type FROM edges")
def _(spark, d):
    return snapshot.restore_edges(spark, _snapshot(spark, d), ents(spark, d))


def vectors(spark, d) -> DataFrame:
    return star.table(spark, d, "embeddings")


def _nearest(spark, d, **options) -> DataFrame:
    points = vectors(spark, d)
    one = points.filter("vec_id = 7").select("embedding").first()
    return vector.search(points, list(one[0]), **options).select("vec_id", "label", "score")


DOUBLES = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), q AS (SELECT e AS y FROM v WHERE vec_id = 7)"
MEASURES = {"cosine": "list_cosine_similarity(e, y)", "dot": "list_dot_product(e, y)", "euclid": "list_distance(e, y)", "inverse": "1 / (1 + list_distance(e, y))"}


def _nearest_sql(metric: str, k: int, where: str = "true") -> str:
    return f"WITH {DOUBLES}, s AS (SELECT vec_id, label, round({MEASURES[metric]}, 12) AS score FROM v, q) SELECT vec_id, label, round(score, 6) AS score FROM s WHERE {where} ORDER BY s.score {'' if metric == 'euclid' else 'DESC'}, vec_id LIMIT {k}"


for _metric in MEASURES:
    query(f"dense_{_metric}", _nearest_sql(_metric, 20))(lambda spark, d, m=_metric: _nearest(spark, d, k=20, metric=m))
query("dense_threshold", _nearest_sql("cosine", 50, "score >= 0.2"))(lambda spark, d: _nearest(spark, d, k=50, threshold=0.2))
query("dense_filtered", _nearest_sql("cosine", 20, "label = 3"))(lambda spark, d: _nearest(spark, d, k=20, where={"label": 3}))


def _many_sql(metric: str) -> str:
    measure = MEASURES[metric].replace("(e, y)", "(a.e, b.e)")
    return f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
s AS (SELECT b.vec_id AS query_id, a.vec_id AS doc_id, round({measure}, 12) AS x FROM v a, v b WHERE b.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, doc_id, round(x, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY x {'' if metric == 'euclid' else 'DESC'}, doc_id) AS rank FROM s) WHERE rank <= 10"""


for _metric in ("cosine", "dot", "euclid"):

    @query(f"dense_many_{_metric}", _many_sql(_metric))
    def _(spark, d, metric=_metric):
        """The nearest of all vectors for every vector whose id is divisible by 50, by cells."""
        points, cells = many.celled(vectors(spark, d), 64)
        asked = vectors(spark, d).filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
        return many.best_vectors(points, cells, asked, 10, metric).rows.select("query_id", "rank", "doc_id", "score")


@query("l2_normalize", "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 3) AS e FROM embeddings) SELECT vec_id, round(list_sum(list_transform(e, lambda x: x / sqrt(list_dot_product(e, e)))), 6) AS total, round(1.0 / (1.0 + sqrt(list_dot_product(e, e))), 6) AS similarity FROM v")
def _(spark, d):
    tripled = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 3)
    v = vectors(spark, d).select("vec_id", tripled.alias("e"))
    return v.select("vec_id", F.round(F.aggregate(vector.l2_normalized(F.col("e")), F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(1.0 / (1.0 + vector.norm(F.col("e"))), 6).alias("similarity"))


@query("point_upsert_repeated", "SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN 7 ELSE label END AS label FROM embeddings")
def _(spark, d):
    """An id that comes several times among the new points: the last one counts."""
    old = vectors(spark, d).select("vec_id", "label")
    some = old.filter("vec_id % 10 = 0").select("vec_id", F.explode(F.array(F.lit(9), F.lit(8), F.lit(7))).alias("label")).withColumn("seq", -F.col("label"))
    return vector.upsert(old, some, seq="seq")


@query("vectors_stored", _nearest_sql("cosine", 20))
def _(spark, d):
    path = f"{shared_folder(spark)}/dense-{uuid.uuid4().hex}"
    indexes.save_vectors(vectors(spark, d), path)
    index = indexes.load_vectors(spark, path)
    one = index["points"].filter("vec_id = 7").select("embedding").first()
    return vector.search(index["points"], list(one[0]), 20, index["metric"]).select("vec_id", "label", "score")


@query("point_upsert", "SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN 99 ELSE label END AS label FROM embeddings UNION ALL SELECT vec_id + 1000000, 99 FROM embeddings WHERE vec_id % 10 = 0")
def _(spark, d):
    old = vectors(spark, d).select("vec_id", "label")
    some = old.filter("vec_id % 10 = 0").withColumn("label", F.lit(99))
    return vector.upsert(old, some.union(some.select((F.col("vec_id") + 1000000).alias("vec_id"), "label")))


@query("delete_by_id", "SELECT vec_id, label FROM embeddings WHERE vec_id % 3 <> 0")
def _(spark, d):
    v = vectors(spark, d).select("vec_id", "label")
    return vector.delete_ids(v, v.filter("vec_id % 3 = 0"))


@query("delete_by_filter", "SELECT vec_id, label FROM embeddings WHERE label <> 4")
def _(spark, d):
    return vector.delete_where(vectors(spark, d).select("vec_id", "label"), {"label": 4})


@query("collection_info", "SELECT count(*) AS points_count, min(len(embedding)) AS dimension FROM embeddings")
def _(spark, d):
    return vectors(spark, d).agg(F.count(F.lit(1)).alias("points_count"), F.min(F.size("embedding").cast("long")).alias("dimension"))


STOP = "(" + ", ".join(f"'{x}'" for x in rank.STOP_WORDS) + ")"
WORDS = f"w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_][a-z0-9_]+'), lambda t: t NOT IN {STOP}) AS w FROM documents)"
TERMS = f"{WORDS}, p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM w) GROUP BY ALL)"
ASK = "thon erst oned ingly heouen"
_ASKED = "(" + ", ".join(f"'{t}'" for t in ASK.split()) + ")"
BM25 = f"""{TERMS}, c AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM w), f AS (SELECT term, count(*) AS df FROM p WHERE term IN {_ASKED} GROUP BY term),
b AS (SELECT p.doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * len(w.w) / avgdl))), 12) AS score FROM p JOIN f ON p.term = f.term JOIN w ON p.doc_id = w.doc_id, c GROUP BY p.doc_id)"""


def docs(spark, d) -> DataFrame:
    return star.spread(star.table(spark, d, "documents"), "doc_id")


def lexical(spark, d, k: int) -> DataFrame:
    return rank.bm25(docs(spark, d), ASK, k)


def semantic(spark, d, k: int) -> DataFrame:
    """Nearest vectors; by the fixtures' convention a vector belongs to the document of its number."""
    return _nearest(spark, d, k=k).select(F.col("vec_id").alias("doc_id"), "score")


@query("bm25_index_stats", f"WITH {TERMS} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM p GROUP BY term")
def _(spark, d):
    return rank.postings(docs(spark, d)).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query("bm25_corpus", f"WITH {WORDS} SELECT count(*) AS n_docs, avg(CAST(len(w) AS DOUBLE)) AS avgdl FROM w")
def _(spark, d):
    return rank.corpus_stats(docs(spark, d))


@query("bm25_search", f"WITH {BM25} SELECT doc_id, round(score, 6) AS score FROM b ORDER BY b.score DESC, doc_id LIMIT 20")
def _(spark, d):
    return lexical(spark, d, 20)


@query("bm25_stored", f"WITH {BM25} SELECT doc_id, round(score, 6) AS score FROM b ORDER BY b.score DESC, doc_id LIMIT 20")
def _(spark, d):
    """The postings written once, and a search that reads its terms' only."""
    path = f"{shared_folder(spark)}/lexical-{uuid.uuid4().hex}"
    indexes.save_lexical(docs(spark, d), path)
    return rank.bm25_stored(indexes.load_lexical(spark, path), ASK, 20)


@query("bm25_least", f"WITH {BM25} SELECT * FROM (SELECT doc_id, round(score, 6) AS score FROM b ORDER BY b.score DESC, doc_id LIMIT 50) WHERE score >= 2.5")
def _(spark, d):
    return rank.bm25(docs(spark, d), ASK, 50, least=2.5)


BM25_MANY = f"""WITH {TERMS}, c AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM w), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT DISTINCT item_id AS query_id, unnest(string_split_regex(lower(text), '\\s+')) AS term FROM benchmark),
s AS (SELECT query_id, p.doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * len(w.w) / avgdl))), 12) AS x
  FROM q JOIN p ON q.term = p.term JOIN f ON p.term = f.term JOIN w ON p.doc_id = w.doc_id, c GROUP BY ALL)
SELECT query_id, CAST(rank AS INT) AS rank, doc_id, round(x, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY x DESC, doc_id) AS rank FROM s) WHERE rank <= 10"""


def questions(spark, d) -> DataFrame:
    return star.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query("bm25_many", BM25_MANY)
def _(spark, d):
    """Every benchmark passage as a query, in one pass over block-max postings."""
    path = fresh(spark, "lexical")
    indexes.save_lexical(docs(spark, d), path)
    return many.bm25(indexes.load_lexical(spark, path), questions(spark, d), 10).rows.select("query_id", "rank", "doc_id", "score")


@query("sparse_encode", f"WITH {TERMS} SELECT doc_id, term, round(1 + ln(tf), 6) AS weight FROM p")
def _(spark, d):
    return rank.sparse_vectors(docs(spark, d))


@query("sparse_dot", f"WITH {TERMS} SELECT doc_id, round(x, 6) AS score FROM (SELECT doc_id, round(sum(round(1 + ln(tf), 6) * CASE term WHEN 'thon' THEN 2.0 ELSE 1.0 END), 12) AS x FROM p WHERE term IN {_ASKED} GROUP BY doc_id) ORDER BY x DESC, doc_id LIMIT 20")
def _(spark, d):
    return rank.sparse_search(docs(spark, d), {t: 2.0 if t == "thon" else 1.0 for t in ASK.split()}, 20)


@query("dense_encode")
def _(spark, d):
    return docs(spark, d).select("doc_id", encode.dense(F.col("text")).alias("vector"))


LISTS = f"""WITH {BM25}, {DOUBLES}, s AS (SELECT vec_id AS doc_id, round({MEASURES['cosine']}, 12) AS score FROM v, q),
la AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (SELECT doc_id, round(score, 6) AS score FROM b ORDER BY b.score DESC, doc_id LIMIT 40)),
lb AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (SELECT doc_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, doc_id LIMIT 40))"""
RRF = ", r AS (SELECT doc_id, round(x, 6) AS score FROM (SELECT doc_id, round(sum(s), 12) AS x FROM (SELECT doc_id, 1.0::DOUBLE / (2.0 + rank - 1) AS s FROM la UNION ALL SELECT doc_id, 1.0::DOUBLE / (2.0 + rank - 1) FROM lb) GROUP BY doc_id) ORDER BY x DESC, doc_id LIMIT 20)"


@query("rrf_fuse", f"{LISTS}{RRF} SELECT * FROM r")
def hybrid(spark, d):
    return rank.rrf([lexical(spark, d, 40), semantic(spark, d, 40)], 20)


def _legacy_sql(least: float, k: int) -> str:
    return f"""{LISTS}, kc AS (SELECT 60.0::DOUBLE * sqrt(greatest((SELECT count(*) FROM la), (SELECT count(*) FROM lb))) AS kc), g AS (SELECT doc_id, sum(0.5::DOUBLE / (kc + rank)) AS x FROM (SELECT doc_id, rank FROM la UNION ALL SELECT doc_id, rank FROM lb), kc GROUP BY doc_id)
SELECT doc_id, round(x, 6) AS score FROM g WHERE x >= {least} ORDER BY round(x, 12) DESC, doc_id LIMIT {k}"""


@query("legacy_rrf", _legacy_sql(0.0, 20))
def _(spark, d):
    return rank.adaptive_rrf(lexical(spark, d, 40), semantic(spark, d, 40), 20)


@query("legacy_rrf_log", _legacy_sql(0.0012, 50))
def _(spark, d):
    """With the log strategy, which keeps the order of scores, and a least score."""
    return rank.adaptive_rrf(lexical(spark, d, 40), semantic(spark, d, 40), 50, least=0.0012, strategy="log")


@query("legacy_one_list", f"""{LISTS}, a AS (SELECT doc_id, exp(sqrt(score) - (SELECT max(sqrt(score)) FROM la)) AS e FROM la) SELECT doc_id, round(e / (SELECT sum(e) FROM a), 6) AS score FROM a ORDER BY round(e / (SELECT sum(e) FROM a), 12) DESC, doc_id LIMIT 20""")
def _(spark, d):
    """Where dense search finds nothing: the softmax of the lexical scores' square roots."""
    return rank.adaptive_rrf(lexical(spark, d, 40), semantic(spark, d, 40).filter("score > 2"), 20, strategy="sqrt")


@query("score_normalize", f"""{LISTS}, a AS (SELECT min(score) AS lo, max(score) AS hi, avg(score) AS mu, stddev_pop(score) AS sd, sum(exp(score - (SELECT max(score) FROM la))) AS e FROM la)
SELECT doc_id, round((score - lo) / (hi - lo), 6) AS minmax, round((score - mu) / sd, 6) AS zscore, round(exp(score - hi) / e, 6) AS softmax, round(ln(1 + score), 6) AS log, round(sqrt(score), 6) AS sqrt FROM la, a""")
def _(spark, d):
    return lexical(spark, d, 40).select("doc_id", *[F.round(rank.normalized(m), 6).alias(m) for m in ("minmax", "zscore", "softmax", "log", "sqrt")])


@query("chunk_context", f"{LISTS}{RRF} SELECT string_agg('[Chunk ' || k || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY k) AS context FROM (SELECT r.doc_id, text, row_number() OVER (ORDER BY score DESC, r.doc_id) AS k FROM r JOIN documents d ON r.doc_id = d.doc_id ORDER BY k LIMIT 5)")
def _(spark, d):
    found = hybrid(spark, d).join(docs(spark, d).select("doc_id", "text"), "doc_id")  # a vector may have no document
    return context.chunk_context(found.orderBy(F.desc("score"), "doc_id").limit(5))


_LINE = "k || '. ' || source_id || ' (Entity' || CASE WHEN source_role = '' THEN '' ELSE ', ' || source_role END || ') --[' || relationship || ']--> ' || target_id || ' (Entity' || CASE WHEN target_role = '' THEN '' ELSE ', ' || target_role END || ')'"


@query("graph_context", f"SELECT string_agg({_LINE}, chr(10) ORDER BY k) AS context FROM (SELECT *, row_number() OVER (ORDER BY source_id, relationship, target_id) AS k FROM ({_search_sql(EXACT, limit=50)}))")
def _(spark, d):
    return context.graph_context(graph_exact(spark, d))


@query("hybrid_retrieval", f"{LISTS}{RRF}, {GRAPH[5:]}, {BOTH.replace('x AS', 'xx AS')} SELECT 'graph' AS leg, source_id || '|' || relationship || '|' || target_id AS item, CAST(NULL AS DOUBLE) AS score FROM (SELECT DISTINCT * FROM xx WHERE {EXACT} ORDER BY source_id, relationship, target_id LIMIT 10) UNION ALL SELECT 'chunk', CAST(doc_id AS VARCHAR), score FROM r")
def _(spark, d):
    found = graph.cascade(ents(spark, d), star.edges(spark, d), TARGETS, limit=10)
    left = found.select(F.lit("graph").alias("leg"), F.concat_ws("|", "source_id", "relationship", "target_id").alias("item"), F.lit(None).cast("double").alias("score"))
    return left.unionByName(hybrid(spark, d).select(F.lit("chunk").alias("leg"), F.col("doc_id").cast("string").alias("item"), "score"))


@query("keyword_source", "SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS INT) AS id, text AS content FROM (SELECT * FROM documents WHERE contains(lower(text), 'license') ORDER BY doc_id LIMIT 10)")
def _(spark, d):
    return star.keyword_documents(docs(spark, d), "license", 10)


def structured(spark, d) -> DataFrame:
    """The documents' lines with marks of structure by their number: the tables themselves hold few headings."""
    marks = ["# ", "", "1. ", "", "| a | ", "", "A) ", "II. ", "", "1.2. ", "Appendix B", "", "## ", "b) "]
    i = F.col("i")
    line = F.col("line")
    at = F.get(F.array(*[F.lit(m) for m in marks]), (i % len(marks)).cast("int"))
    made = F.when(i % 14 == 10, at).when(i % 14 == 11, "").when(i % 14 == 4, F.concat(at, F.translate(line, "#|", ""), F.lit(" |"))).otherwise(F.concat(at, line))
    rows = star.dealt_documents(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).select("doc_id", "i", made.alias("line"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("content"))


LINES = r"""WITH l AS (SELECT doc_id, i, x[i + 1] AS line FROM (SELECT doc_id, x, unnest(range(0, len(x))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))),
m AS (SELECT doc_id, i, CASE i % 14 WHEN 10 THEN 'Appendix B' WHEN 11 THEN '' WHEN 4 THEN '| a | ' || replace(replace(line, '#', ''), '|', '') || ' |'
  WHEN 0 THEN '# ' || line WHEN 2 THEN '1. ' || line WHEN 6 THEN 'A) ' || line WHEN 7 THEN 'II. ' || line WHEN 9 THEN '1.2. ' || line WHEN 12 THEN '## ' || line WHEN 13 THEN 'b) ' || line ELSE line END AS line FROM l),
classed AS (SELECT doc_id, CAST(i AS INT) AS i, line, trim(line) AS t, CASE WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(trim(line), '(?i)^(appendix(\s+[a-z0-9]+)?|notes?|references?)$') THEN 'special'
  WHEN regexp_matches(trim(line), '^[^#]*#{1,9}([^#].*)$') AND NOT regexp_matches(trim(line), '^[^#]*#+\s*$') OR regexp_matches(trim(line), '^([A-HJ-UW-Z]|[IVX]+|\d+|\d+\.\d+|\d+\.\d+\.\d+|[a-z])[.)]\s+.+$') THEN 'heading'
  WHEN regexp_matches(line, '^\s*\|.*\|\s*$') THEN 'row' ELSE 'text' END AS kind FROM m)"""
LINES_SQL = f"{LINES} SELECT doc_id, i, kind FROM classed"


@query("line_classify", LINES_SQL)
def _(spark, d):
    return chunker.lines(structured(spark, d)).select("doc_id", "i", "kind")


def chunked(spark, d) -> DataFrame:
    return chunker.chunks(structured(spark, d), size=120)


#: Chunks by windows over lines and elements; the sections a heading stands under are a fold over the headings since the last special section.
CHUNKS = rf"""{LINES}, marked AS (
  SELECT *, regexp_matches(line, '^\s*\|.*\|\s*$') AS is_row,
    CASE WHEN kind <> 'heading' THEN NULL WHEN regexp_matches(t, '^[^#]*#{{1,9}}[^#]') THEN 0 WHEN regexp_matches(t, '^[A-HJ-UW-Z][.)]\s') THEN 1 WHEN regexp_matches(t, '^[IVX]+[.)]\s') THEN 2
      WHEN regexp_matches(t, '^\d+[.)]\s') THEN 3 WHEN regexp_matches(t, '^\d+\.\d+[.)]\s') THEN 4 WHEN regexp_matches(t, '^\d+\.\d+\.\d+[.)]\s') THEN 5 ELSE 6 END AS family,
    CASE WHEN kind <> 'special' THEN NULL WHEN lower(t) LIKE 'appendix%' THEN 'Phụ lục' WHEN lower(t) LIKE 'note%' THEN 'Chú thích' ELSE 'Tài liệu tham khảo' END AS special FROM classed),
titled AS (
  SELECT *, CASE WHEN family = 0 THEN length(regexp_extract(t, '^[^#]*(#+)', 1)) END AS depth,
    CASE WHEN family = 0 THEN regexp_extract(t, '^[^#]*#+\s*(.+)$', 1) WHEN family > 0 AND NOT ends_with(t, '.') THEN regexp_replace(t, '^([A-Za-z0-9.]*[A-Za-z0-9])[.)]\s+', '\1. ') WHEN family > 0 THEN t END AS title FROM marked),
stretches AS (SELECT *, count(*) FILTER (NOT is_row AND kind <> 'blank') OVER (PARTITION BY doc_id ORDER BY i) AS stretch FROM titled),
tables AS (SELECT *, (is_row OR kind = 'blank') AND count(*) FILTER (kind = 'row') OVER (PARTITION BY doc_id, stretch ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS within FROM stretches),
roles AS (SELECT *, CASE WHEN within AND is_row THEN 'more rows' WHEN within THEN 'gap' WHEN kind = 'blank' AND lag(kind) OVER w = 'text' AND coalesce(lead(kind) OVER w, '') <> 'blank' THEN 'joint' ELSE kind END AS role FROM tables WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
begun AS (SELECT *, role IN ('heading', 'special', 'blank', 'row') OR role = 'text' AND coalesce(lag(role) OVER (PARTITION BY doc_id ORDER BY i), '') NOT IN ('text', 'joint') AS begins FROM roles),
placed AS (SELECT *, count(*) FILTER (begins) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM begun),
els AS (SELECT doc_id, e, arg_min(role, i) AS role, string_agg(line, chr(10) ORDER BY i) AS content, arg_min(family, i) AS family, arg_min(depth, i) AS depth, arg_min(title, i) AS title, arg_min(special, i) AS special
  FROM placed WHERE role NOT IN ('blank', 'gap') GROUP BY ALL),
ranked AS (SELECT doc_id, e, CASE WHEN family = 0 THEN depth ELSE (SELECT coalesce(max(depth), 0) FROM els x WHERE x.doc_id = y.doc_id AND x.role = 'heading') + dense_rank() OVER (PARTITION BY doc_id, family = 0 ORDER BY family) END AS level FROM els y WHERE role = 'heading'),
scoped AS (SELECT els.*, level, count(*) FILTER (role = 'special') OVER w AS scope, count(*) FILTER (role IN ('heading', 'special')) OVER w AS block, last_value(special IGNORE NULLS) OVER w AS active
  FROM els LEFT JOIN ranked USING (doc_id, e) WINDOW w AS (PARTITION BY doc_id ORDER BY e)),
folded AS (SELECT doc_id, es, list_reduce(list_prepend({{'level': 0, 'stack': CAST([] AS VARCHAR[]), 'seen': CAST([] AS VARCHAR[][])}}, hs),
    lambda a, x: {{'level': x.level, 'stack': a.stack[1:x.level - 1] || x.stack, 'seen': list_append(a.seen, a.stack[1:x.level - 1] || x.stack)}}).seen AS seen
  FROM (SELECT doc_id, scope, list(e ORDER BY e) AS es, list({{'level': CAST(level AS INT), 'stack': [title], 'seen': CAST([] AS VARCHAR[][])}} ORDER BY e) AS hs FROM scoped WHERE role = 'heading' GROUP BY ALL)),
stacks AS (SELECT doc_id, unnest(es) AS e, unnest(seen) AS stack FROM folded),
tops AS (SELECT doc_id, block, role, level, coalesce(stack, CAST([] AS VARCHAR[])) AS stack, active, lead(role) OVER (PARTITION BY doc_id ORDER BY block) AS next FROM scoped LEFT JOIN stacks USING (doc_id, e) WHERE role IN ('heading', 'special')),
bodies AS (SELECT doc_id, block, string_agg(content, chr(10) || chr(10) ORDER BY e) AS content, count(*) AS n, bool_or(role = 'row') AS tabular FROM scoped WHERE role NOT IN ('heading', 'special') GROUP BY ALL),
listed AS (
  SELECT doc_id, block, 0 AS o, CASE WHEN role = 'special' OR level = 1 THEN 'section' ELSE 'subsection' END AS chunk_type, CASE WHEN role = 'special' THEN 1 ELSE level END AS level,
    CASE WHEN active IS NULL THEN stack ELSE list_prepend(active, stack) END AS sections, CAST(NULL AS VARCHAR) AS content, 1 AS n FROM tops
  UNION ALL SELECT b.doc_id, b.block, 1, CASE WHEN tabular THEN 'table' ELSE 'paragraph' END, CASE WHEN t.role = 'heading' THEN t.level + 1 ELSE 1 END,
    CASE WHEN active IS NULL OR next = 'special' THEN coalesce(stack, CAST([] AS VARCHAR[])) ELSE list_prepend(active, stack) END, content, n FROM bodies b LEFT JOIN tops t ON b.doc_id = t.doc_id AND b.block = t.block),
counted AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block, o) - 1 AS chunk, coalesce(len(regexp_extract_all(content, '\S+')), 0) AS tokens FROM listed),
chunked AS (SELECT doc_id, CAST(chunk AS INT) AS chunk, chunk_type, CAST(level AS INT) AS level, sections, content, n AS element_count, CAST(tokens AS INT) AS tokens, tokens > 120 AS is_oversized FROM counted)"""


@query("structural_chunks", f"{CHUNKS} SELECT doc_id, chunk, chunk_type, level, array_to_string(sections, ' > ') AS hierarchy, content, element_count, tokens, is_oversized FROM chunked")
def _(spark, d):
    return chunked(spark, d).select("doc_id", "chunk", "chunk_type", "level", F.array_join("hierarchy", " > ").alias("hierarchy"), "content", "element_count", "tokens", "is_oversized")


@query("structure_tree", f"{CHUNKS} SELECT doc_id, path, count(*) AS n_chunks FROM (SELECT doc_id, array_to_string(sections[1:unnest(range(1, len(sections) + 1))], ' > ') AS path FROM chunked) GROUP BY ALL")
def _(spark, d):
    return chunker.structure_tree(chunked(spark, d))


@query("recursive_split")
def _(spark, d):
    return chunker.split_oversized(chunked(spark, d), 120).drop("hierarchy")


@query("structure_summary", f"{CHUNKS} SELECT doc_id, count(*) AS n_chunks, count(*) FILTER (is_oversized) AS n_oversized, CAST(max(len(sections)) AS INT) AS max_depth FROM chunked GROUP BY doc_id")
def _(spark, d):
    return chunker.structure_summary(chunked(spark, d))


@query("chunk_export", f"{CHUNKS} SELECT doc_id, chunk, CAST(to_json({{'chunk_id': chunk, 'level': level, 'chunk_type': chunk_type, 'section_hierarchy': sections, 'is_oversized': is_oversized, 'parent_chunk_id': NULL, 'content': content}}) AS VARCHAR) AS json, count(*) OVER (PARTITION BY doc_id) AS total_chunks FROM chunked")
def _(spark, d):
    return chunker.export(chunked(spark, d))


_ALL = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9_][a-z0-9_]+')"
_SLOT = "CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT) % 256"
DENSE = f"""ds AS (SELECT doc_id, slot, count(*) AS c FROM (SELECT doc_id, {_SLOT.format('t')} AS slot FROM (SELECT doc_id, unnest({_ALL.format('text')}) AS t FROM documents)) GROUP BY ALL),
dn AS (SELECT doc_id, sqrt(CAST(sum(c * c) AS DOUBLE)) AS n FROM ds GROUP BY doc_id)"""


@query("dense_encode_slots", f"WITH {DENSE} SELECT doc_id, CAST(slot AS INT) AS slot, round(c / n, 6) AS weight FROM ds JOIN dn USING (doc_id)")
def _(spark, d):
    found = docs(spark, d).select("doc_id", F.posexplode(encode.hashed()(F.col("text"))).alias("slot", "weight"))
    return found.filter("weight > 0").select("doc_id", "slot", F.round("weight", 6).alias("weight"))


def points(spark, d) -> DataFrame:
    """The documents as points, one chunk each, written once."""
    chunks = docs(spark, d).select(F.col("doc_id").alias("seq"), F.col("doc_id").alias("chunk_id"), "doc_id", F.lit("paragraph").alias("chunk_type"), F.col("text").alias("content"))
    path = f"{shared_folder(spark)}/points-{uuid.uuid4().hex}"
    indexing.points_of(chunks).write.options(**PACKED).parquet(path)
    return spark.read.parquet(path)


def _hybrid_sql(k: int) -> str:
    q = " UNION ALL ".join(f"SELECT {_SLOT.format(repr(t))} AS slot" for t in ASK.split())
    return f"""WITH {TERMS}, {DENSE}, qs AS (SELECT slot, count(*) AS c FROM ({q}) GROUP BY slot), qn AS (SELECT sqrt(CAST(sum(c * c) AS DOUBLE)) AS n FROM qs),
dense AS (SELECT CAST(dn.doc_id AS VARCHAR) AS id, round(coalesce(sum(ds.c * qs.c) FILTER (WHERE qs.slot IS NOT NULL), 0) / (max(dn.n) * max(qn.n)), 12) AS score FROM dn JOIN ds USING (doc_id) LEFT JOIN qs ON ds.slot = qs.slot, qn GROUP BY dn.doc_id),
sparse AS (SELECT CAST(doc_id AS VARCHAR) AS id, round(sum(1 + ln(CAST(tf AS DOUBLE))), 12) AS score FROM p WHERE term IN {_ASKED} GROUP BY doc_id),
da AS (SELECT id, round(score, 6) AS score FROM (SELECT * FROM dense ORDER BY score DESC, id LIMIT {2 * k})), sa AS (SELECT id, round(score, 6) AS score FROM (SELECT * FROM sparse ORDER BY score DESC, id LIMIT {2 * k})),
ranked AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM da UNION ALL SELECT id, row_number() OVER (ORDER BY score DESC, id) FROM sa),
fused AS (SELECT id, round(x, 6) AS score FROM (SELECT id, round(sum(1.0::DOUBLE / (1 + rank)), 12) AS x FROM ranked GROUP BY id) ORDER BY x DESC, id LIMIT {k}),
semantic AS (SELECT id, round(score, 6) AS score FROM dense ORDER BY dense.score DESC, id LIMIT {k})"""


def _shown(found: DataFrame) -> DataFrame:
    return found.select("chunk_id", F.length("chunk_text").alias("n_chars"), "score", F.col("metadata")["doc_id"].alias("doc_id"), *[c for c in found.columns if c in ("total", "search_type")])


_SHOWN = "id AS chunk_id, CAST(length(text) AS INT) AS n_chars, score, id AS doc_id"


@query("hybrid_search", f"{_hybrid_sql(20)} SELECT {_SHOWN}, count(*) OVER () AS total, 'hybrid' AS search_type FROM fused f JOIN documents d ON f.id = CAST(d.doc_id AS VARCHAR)")
def _(spark, d):
    return _shown(retrieval.search(points(spark, d), ASK, 20))


def _asked_many(kind: str, k: int) -> str:
    leg = f"""SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(x, 12) DESC, id) AS rank"""
    last = {"hybrid": f"(SELECT query_id, id, round(sum(1.0::DOUBLE / (1 + rank)), 12) AS x FROM (SELECT * FROM da WHERE rank <= {2 * k} UNION ALL SELECT * FROM sa WHERE rank <= {2 * k}) GROUP BY ALL)", "semantic": "dense"}[kind]
    return f"""WITH {TERMS}, {DENSE}, qt AS (SELECT item_id AS query_id, unnest({_ALL.format('text')}) AS t FROM benchmark),
qs AS (SELECT query_id, slot, count(*) AS c FROM (SELECT query_id, {_SLOT.format('t')} AS slot FROM qt) GROUP BY ALL), qn AS (SELECT query_id, sqrt(CAST(sum(c * c) AS DOUBLE)) AS n FROM qs GROUP BY query_id),
met AS (SELECT qs.query_id, ds.doc_id, sum(ds.c * qs.c) AS c FROM ds JOIN qs ON ds.slot = qs.slot GROUP BY ALL),
dense AS (SELECT qn.query_id, CAST(dn.doc_id AS VARCHAR) AS id, coalesce(c, 0) / (dn.n * qn.n) AS x FROM qn CROSS JOIN dn LEFT JOIN met ON met.query_id = qn.query_id AND met.doc_id = dn.doc_id),
qw AS (SELECT query_id, t, 1 + ln(CAST(count(*) AS DOUBLE)) AS w FROM qt GROUP BY ALL),
sparse AS (SELECT query_id, CAST(doc_id AS VARCHAR) AS id, sum(w * (1 + ln(CAST(tf AS DOUBLE)))) AS x FROM p JOIN qw ON term = t GROUP BY ALL),
da AS ({leg} FROM dense), sa AS ({leg} FROM sparse), r AS ({leg}, x FROM {last})
SELECT query_id, CAST(rank AS INT) AS rank, id AS chunk_id, CAST(length(text) AS INT) AS n_chars, round(x, 6) AS score, id AS doc_id, count(*) OVER (PARTITION BY query_id) AS total, '{kind}' AS search_type
FROM r JOIN documents d ON r.id = CAST(d.doc_id AS VARCHAR) WHERE rank <= {k}"""


for _kind in ("hybrid", "semantic"):

    @query(f"{_kind}_many", _asked_many(_kind, 10))
    def _(spark, d, kind=_kind):
        """Every benchmark passage asked of a stored hybrid index in one pass."""
        path = fresh(spark, "hybrid")
        hybrids.save(points(spark, d), path, 256)
        found = retrieval.search_many(hybrids.load(spark, path), questions(spark, d), 10, search_type=kind)
        return found.select("query_id", "rank", "chunk_id", F.length("chunk_text").alias("n_chars"), "score", F.col("metadata")["doc_id"].alias("doc_id"), "total", "search_type")


@query("hybrid_search_threshold", f"{_hybrid_sql(20)} SELECT {_SHOWN} FROM fused f JOIN documents d ON f.id = CAST(d.doc_id AS VARCHAR) WHERE score >= 0.05")
def _(spark, d):
    return _shown(retrieval.hybrid_search(points(spark, d), ASK, 20, 0.05))


@query("semantic_search", f"{_hybrid_sql(20)} SELECT {_SHOWN}, count(*) OVER () AS total, 'semantic' AS search_type FROM semantic f JOIN documents d ON f.id = CAST(d.doc_id AS VARCHAR)")
def _(spark, d):
    return _shown(retrieval.search(points(spark, d), ASK, 20, search_type="semantic"))


def _response_sql(found: str, graph_sql: str, kind: str, k: int = 5) -> str:
    chunk = f"(SELECT string_agg('[Chunk ' || k || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY k) FROM (SELECT text, row_number() OVER (ORDER BY score DESC, f.id) AS k FROM {found} f JOIN documents d ON f.id = CAST(d.doc_id AS VARCHAR)))"
    return f"{_hybrid_sql(k)}{graph_sql[0]} SELECT 'No answer generated.' AS answer, {graph_sql[1]} AS graph_context, {chunk} AS chunk_context, '{kind}' AS search_type"


@query("response_semantic", _response_sql("semantic", ("", "'No graph context (Semantic Search mode).'"), "semantic"))
def _(spark, d):
    return retrieval.respond_semantic(points(spark, d), ASK)


@query("response_hybrid", _response_sql("fused", ("", "'No graph context (Hybrid Search mode).'"), "hybrid"))
def _(spark, d):
    return retrieval.respond_hybrid(points(spark, d), ASK)


_FOUND = f", {GRAPH[5:]}, {BOTH}, hit AS (SELECT DISTINCT * FROM x WHERE ({EXACT}){''.join(f' AND lower({c}) NOT IN {_low(EXCLUDED)}' for c in ('source_id', 'source_role', 'target_id', 'target_role'))} ORDER BY source_id, relationship, target_id LIMIT 10)"


@query("response_full", _response_sql("fused", (_FOUND, f"(SELECT string_agg({_LINE}, chr(10) ORDER BY k) FROM (SELECT *, row_number() OVER (ORDER BY source_id, relationship, target_id) AS k FROM hit))"), "full"))
def _(spark, d):
    import json

    told = json.dumps({"target_entities": TARGETS, "excluded_entities": EXCLUDED, "normalized_query": ASK})
    return retrieval.respond(ents(spark, d), star.edges(spark, d), points(spark, d), "who lives where?", told)


def extracted(spark, d) -> DataFrame:
    """All documents as chunks with payloads about the customer of their number (a guest from nowhere, where there is none);
    every seventh is cut off, every eleventh lacks a list."""
    c = star.table(spark, d, "customer").join(star.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k, segment = F.col("doc_id"), F.coalesce("c_mktsegment", F.lit("GUEST"))
    name, land = F.coalesce("c_name", F.concat(F.lit("Guest "), k)), F.coalesce("n_name", F.lit("Nowhere"))
    node = lambda i, t, r: F.struct(i.alias("id"), F.lit(t).alias("entity_type"), r.alias("entity_role"))
    rel = lambda s, t, r: F.struct(s.alias("source"), t.alias("target"), F.lit(r).alias("relationship_type"))
    nodes = F.array(node(F.concat(F.lit("- "), name), "customer", segment), node(F.concat(land, F.lit(" (land)")), "home country", F.lit(None).cast("string")))
    rels = F.array(rel(name, land, "born in"), rel(name, F.lit("nobody"), "knows"), rel(name, name, "is"))
    whole = F.to_json(F.struct(nodes.alias("nodes"), F.when(k % 11 != 0, rels).alias("relationships")))
    payload = F.when(k % 7 == 0, F.left(whole, F.length(whole) - 5)).otherwise(whole)
    rows = docs(spark, d).join(c, F.col("doc_id") == F.col("c_custkey"), "left")
    return rows.select(k.alias("seq"), F.when(k % 2 == 0, k).alias("chunk_id"), k.alias("doc_id"), F.lit("paragraph").alias("chunk_type"), F.col("text").alias("content"), payload.alias("payload"))


def indexed(spark, d, clear: bool = False):
    return indexing.index(extracted(spark, d), ents(spark, d), star.edges(spark, d), clear=clear)


TOLD = """told AS (SELECT doc_id, coalesce(c_name, 'Guest ' || doc_id) AS c_name, coalesce(n_name, 'Nowhere') AS n_name, coalesce(c_mktsegment, 'GUEST') AS c_mktsegment, text
  FROM documents LEFT JOIN (customer JOIN nation ON c_nationkey = n_nationkey) ON doc_id = c_custkey
  WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND regexp_matches(text, '\\S')),
nodes AS (SELECT doc_id, c_name AS id, 'customer' AS entity_type, c_mktsegment AS entity_role FROM told UNION ALL SELECT doc_id, n_name, 'home country', '' FROM told)"""


@query("index_nodes", f"WITH {TOLD} SELECT DISTINCT doc_id // 5 AS batch, id, entity_type, entity_role FROM nodes")
def _(spark, d):
    return indexed(spark, d).nodes.select("batch", "id", "entity_type", "entity_role")


@query("index_relationships", f"WITH {TOLD} SELECT doc_id // 5 AS batch, c_name AS source, n_name AS target, 'born in' AS rel_type FROM told UNION SELECT doc_id // 5, c_name, 'nobody', 'knows' FROM told UNION SELECT doc_id // 5, c_name, c_name, 'is' FROM told")
def _(spark, d):
    return indexed(spark, d).relationships.select("batch", "source", "target", "rel_type")


INDEXED = f"""{GRAPH}, {TOLD}, labelled AS (SELECT id, entity_type, entity_role, doc_id AS seq, upper(replace(entity_type, ' ', '_')) AS label FROM nodes UNION ALL SELECT id, entity_type, entity_role, -1, upper(entity_type) FROM entities),
after AS (SELECT id, arg_max(entity_type, seq) AS entity_type, arg_max(entity_role, seq) AS entity_role, 'Entity;' || string_agg(DISTINCT label, ';' ORDER BY label) AS labels FROM labelled GROUP BY id),
born AS (SELECT DISTINCT c_name AS source, n_name AS target, 'BORN_IN' AS rel_type FROM told)"""


@query("index_entities", f"{INDEXED} SELECT * FROM after")
def _(spark, d):
    return indexed(spark, d).entities.select("id", "entity_type", "entity_role", F.concat_ws(";", "labels").alias("labels"))


@query("index_edges", f"{INDEXED} SELECT * FROM edges UNION SELECT * FROM born")
def _(spark, d):
    return indexed(spark, d).edges


@query("index_points", f"WITH {TERMS}, {TOLD}, {DENSE} SELECT CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) ELSE sha256(doc_id || '|' || doc_id) END AS id, CAST(doc_id AS VARCHAR) AS doc_id, (SELECT count(*) FROM p WHERE p.doc_id = told.doc_id) AS n_terms, (SELECT count(*) FROM ds WHERE ds.doc_id = told.doc_id) AS n_slots FROM told WHERE doc_id IN (SELECT doc_id FROM dn)")
def _(spark, d):
    return indexed(spark, d).points.select("id", "doc_id", F.size("sparse").cast("long").alias("n_terms"), F.size(F.filter("dense", lambda x: x > 0)).cast("long").alias("n_slots"))


_COUNTS = "(SELECT count(*) FROM told WHERE doc_id IN (SELECT doc_id FROM dn)) AS n_points"


@query("index_counts", f"{INDEXED}, {DENSE} SELECT (SELECT count(*) FROM (SELECT DISTINCT doc_id // 5, id, entity_type, entity_role FROM nodes)) AS n_nodes, (SELECT count(*) FROM told) AS n_relationships, (SELECT count(*) FROM after) AS n_entities, (SELECT count(*) FROM (SELECT * FROM edges UNION SELECT * FROM born)) AS n_edges, {_COUNTS}")
def _(spark, d):
    _, counts = indexing.index_once(extracted(spark, d), ents(spark, d), star.edges(spark, d))
    return spark.createDataFrame([tuple(counts.values())], ", ".join(f"{k} long" for k in counts))


@query("index_cleared", f"WITH {TOLD}, {DENSE} SELECT (SELECT count(*) FROM (SELECT DISTINCT doc_id // 5, id, entity_type, entity_role FROM nodes)) AS n_nodes, (SELECT count(*) FROM told) AS n_relationships, (SELECT count(DISTINCT id) FROM nodes) AS n_entities, (SELECT count(*) FROM told) AS n_edges, {_COUNTS}")
def _(spark, d):
    """From an empty graph: only what the chunks tell is there."""
    return indexed(spark, d, clear=True).counts()


@query("collection_lifecycle", f"WITH {DENSE}, n AS (SELECT count(*) AS n FROM dn) SELECT * FROM (VALUES ('created', 0, true), ('cleared', 0, true), ('dropped', 0, false)) t(step, points_count, there) UNION ALL SELECT 'filled', n, true FROM n UNION ALL SELECT 'filled again', n, true FROM n")
def _(spark, d):
    """A collection made, filled, filled again with the same points, cleared and dropped: its points after each step."""
    name, found, rows = f"chunks_{uuid.uuid4().hex}", points(spark, d), []
    told = lambda step: rows.append((step, (indexes.info(spark, name) or {"points_count": 0})["points_count"], indexes.exists(spark, name)))
    indexes.ensure(spark, name, 256)
    indexes.create(spark, name, 256)
    told("created")
    for step in ("filled", "filled again"):
        indexes.put(spark, name, found, "seq")
        told(step)
    indexes.clear(spark, name)
    told("cleared")
    indexes.drop(spark, name)
    told("dropped")
    return spark.createDataFrame(rows, "step string, points_count long, there boolean")


def _told(content):
    """A payload from a text's first two words, in the place of a model's answer."""
    words = F.split(content, r"\s+")
    return F.to_json(F.struct(F.array(*[F.struct(F.get(words, i).alias("id"), F.lit("word").alias("entity_type"), F.lit("").alias("entity_role")) for i in (0, 1)]).alias("nodes"), F.array(F.struct(F.get(words, 0).alias("source"), F.get(words, 1).alias("target"), F.lit("before").alias("relationship_type"))).alias("relationships")))


@query("index_keyword", """WITH k AS (SELECT doc_id, text FROM documents WHERE contains(lower(text), 'license') ORDER BY doc_id LIMIT 10) SELECT count(*) AS n_documents FROM k""")
def _(spark, d):
    """From a keyword to points, counted by document."""
    made, _ = indexing.index_keyword(docs(spark, d), "license", _told, ents(spark, d), star.edges(spark, d), clear=True)
    return made.points.agg(F.count_distinct("doc_id").alias("n_documents"))
