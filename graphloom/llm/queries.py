"""The registered queries of this subpackage, with DuckDB SQL for the same rows where SQL can express them.

Each query is thin: it calls its operator with production parameters on the whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fill_middle, language, licenses, main_text, manifest, mixing, near_dups, packing, quality, repeated_words, secret_scan, suffix_repeats, topk
from .common import documents


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(documents(spark, sf_dir)).select("doc_id", "spans")

    def digest(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")

    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(digest(F.filter("spans", lambda x: x["kind"] != "random")), 256).alias("base_sha256"),
        digest(F.col("spans")).alias("spans"),
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "text", "lang", "source", "n_chars", F.col("copy").cast("long").alias("copy"), "mix_key")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "soft_failed", "host_rate"
    )


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(documents(spark, sf_dir))
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), "n_windows", "containment")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary())


def op4_repeated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_words.dedup(documents(spark, sf_dir), keep=False)


def op10_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_repeats.dedup(documents(spark, sf_dir), keep=False)


def op5_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.classes(documents(spark, sf_dir))


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(documents(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4  # null where the id is: not held out, and not learned from
    held_out = F.coalesce(remainder == 2, F.lit(False))
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", held_out.alias("held_out"))
    model = language.train(docs.filter(~F.col("held_out") & F.col("doc_id").isNotNull()))
    return language.predict(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_middle.transform(documents(spark, sf_dir))
    again = fill_middle.restored(F.col("output"), F.col("form"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(documents(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = F.when(third, F.translate("text", manifest.UPPER, manifest.LOWER)).otherwise(F.col("text"))
    return manifest.manifest(documents(spark, sf_dir), tampered=lowered).drop("path")


QUERIES = {"op1_topk": op1_topk, "op3_language": op3_language, "op5_near_dups": op5_near_dups, "op4_repeated_words": op4_repeated_words, "op10_suffix_repeats": op10_suffix_repeats, "op8_licenses": op8_licenses, "op9_packing": op9_packing, "op2_secret_scan": op2_secret_scan, "op6_mixing": op6_mixing, "op7_quality": op7_quality, "op11_fill_middle": op11_fill_middle, "op12_main_text": op12_main_text, "op13_manifest": op13_manifest}

SPACES = r"[\x20\x09-\x0D]+"

OP7_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '{SPACES}'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] || ' ' || ws[i + 4] AS g
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 5)) AS k) GROUP BY rid),
m AS (SELECT w.rid, doc_id, host, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '{SPACES}', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN rep ON w.rid = rep.rid),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
             100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words AS soft_failed FROM m),
h AS (SELECT host, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE base_failed OR soft_failed) AS DOUBLE) AS bad FROM f GROUP BY host),
s AS (SELECT sum(bad) / sum(n) AS mu, greatest(sum(bad * bad / n) / sum(n) - (sum(bad) / sum(n)) * (sum(bad) / sum(n)), 1e-9) AS v FROM h),
p AS (SELECT mu, CASE WHEN mu = 0 OR mu = 1 THEN NULL ELSE least(greatest(mu * (1 - mu) / v - 1, 1.0), 1e4) END AS k FROM s),
r AS (SELECT host, (bad + coalesce(mu * k, 0.5)) / (n + (coalesce(mu * k, 0.5) + coalesce((1 - mu) * k, 0.5))) AS rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (soft_failed AND rate > 0.5) AS kept, soft_failed, round(rate, 6) AS host_rate
FROM f JOIN r ON f.host = r.host
"""

OP6_SQL = """
WITH RECURSIVE c AS (SELECT coalesce('=' || source, '-') AS k, count(*) AS n FROM documents GROUP BY 1),
r AS (SELECT k, (1.0::DOUBLE / (SELECT count(*) FROM c)) * (SELECT sum(n) FROM c)::DOUBLE / n AS rate FROM c),
cdf AS (SELECT k, rate, 0 AS j, exp(-rate) AS p, exp(-rate) AS f FROM r
        UNION ALL SELECT k, rate, j + 1, p * rate / (j + 1), f + p * rate / (j + 1) FROM cdf WHERE j + 1 < CAST(trunc(rate + 12.0 * sqrt(rate) + 20.0) AS INT)),
u AS (SELECT *, coalesce('=' || source, '-') AS k, CAST('0x' || substr(md5('0|' || doc_id || '|-|0'), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0 AS u FROM documents),
n AS (SELECT u.doc_id, count(*) AS n FROM u JOIN cdf ON u.k = cdf.k AND u.u >= cdf.f GROUP BY u.doc_id)
SELECT d.doc_id, text, lang, source, n_chars, copy, md5('order|0|' || d.doc_id || '|-|' || copy) AS mix_key
FROM documents d JOIN (SELECT doc_id, unnest(range(0, n)) AS copy FROM n) x ON d.doc_id = x.doc_id
"""


def _located(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    """SQL for the matches of a pattern with their places, as located() makes them."""
    p = pattern.replace("'", "''")
    return f"""SELECT rid, s, s + len(m[i]) AS e, {rank} AS k, '{kind}' AS kind, v[i] AS v FROM (
      SELECT rid, i, m, v, CAST(coalesce(list_sum(list_transform(g[1:i], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) AS BIGINT) AS s
      FROM (SELECT rid, m, v, g, unnest(range(1, len(m) + 1)) AS i FROM (
        SELECT rid, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS v, string_split_regex(t, '{p}') AS g FROM d))) WHERE len(v[i]) >= {least}"""


def _op2_sql() -> str:
    s = secret_scan
    base = " UNION ALL ".join(_located(kind, k, p, g, least) for k, (kind, p, g, least) in enumerate(s.KINDS))
    alphabet = "CASE " + " ".join(f"WHEN regexp_matches(v, '{p}') THEN '{a}'" for _, p, a in s.ENCODINGS[:-1]) + f" ELSE '{s.ENCODINGS[-1][2]}' END"
    log2 = f"({s.GRID} / ln(2))"
    tail = f"""CASE WHEN t / (n - 1) <= q THEN 0 ELSE least({s.MAX_BIN}, floor((n - 1) * (t / (n - 1) * ln(t / (n - 1) / q) + CASE WHEN t < n - 1 THEN (1 - t / (n - 1)) * ln((1 - t / (n - 1)) / (1 - q)) ELSE 0 END) * {log2})) END"""
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
base AS ({base}),
tok AS (SELECT *, regexp_replace(v, '=+$', '') AS body, {alphabet} AS a FROM ({_located("random", 3, s.TOKEN, 0, 20)})),
code AS (SELECT *, CAST(length(body) AS DOUBLE) AS n, CAST(length(regexp_replace(body, '[0-9]+|[a-z]+|[A-Z]+|[^0-9A-Za-z]+', 'x', 'g')) - 1 AS DOUBLE) AS t, CAST(length(a) AS DOUBLE) AS m,
                list_transform(string_split(body, ''), lambda c: CAST(instr(a, c) AS DOUBLE)) AS x, floor(log2(CAST(length(v) AS DOUBLE))) AS c FROM tok),
stat AS (SELECT *, list_sum(list_transform(list_distinct(x), lambda y: power(len(list_filter(x, lambda z: z = y)), 2))) * m / n - n AS chi, 2.0 / (9.0 * (m - 1)) AS sp,
                CAST(len(list_filter(x, lambda y: 2 * y <= m)) AS DOUBLE) AS low, list_sum(x) / n AS mean,
                1.0 + len(list_filter(range(2, len(x) + 1), lambda i: (2 * x[i] <= m) <> (2 * x[i - 1] <= m))) AS runs FROM code WHERE n >= 20),
zs AS (SELECT *, (power(chi / (m - 1), 1.0 / 3.0) - (1.0 - sp)) / sqrt(sp) AS zc,
             CASE WHEN low > 0 AND low < n THEN (runs - 2.0 * low * (n - low) / n - 1.0) / sqrt(greatest(2.0 * low * (n - low) / n * (2.0 * low * (n - low) / n - 1.0) / (n - 1.0), 1e-9)) ELSE 99.0 END AS zr,
             CASE WHEN list_sum(list_transform(x, lambda y: (y - mean) * (y - mean))) > 0 THEN
               list_sum(list_transform(range(1, len(x)), lambda i: (x[i] - mean) * (x[i + 1] - mean))) / list_sum(list_transform(x, lambda y: (y - mean) * (y - mean))) * sqrt(n) ELSE 99.0 END AS zl FROM stat),
fact AS (SELECT rid, s, e, c, n, t, least({s.MAX_BIN}, floor(greatest(0.0, (power(greatest(abs(zc), abs(zr), abs(zl)), 2) / 2.0 - ln(6.0)) * {log2}))) AS z FROM zs
         UNION ALL SELECT rid, s, e, c, n, t, {s.MAX_BIN} FROM code WHERE n < 20),
cnt AS (SELECT c, count(*) AS m FROM fact GROUP BY c),
bar AS (SELECT h.c, min(h.z) AS z FROM (SELECT c, z, sum(count(*)) OVER (PARTITION BY c ORDER BY z DESC) AS r FROM fact GROUP BY c, z) h JOIN cnt ON h.c = cnt.c
        WHERE h.z > 0 AND power(2.0, -h.z / {float(s.GRID)}) <= {s.FDR_TEXT} * h.r / cnt.m GROUP BY h.c),
sorted_ AS (SELECT fact.*, coalesce(fact.z >= bar.z, false) AS is_text FROM fact LEFT JOIN bar ON fact.c = bar.c),
rates AS (SELECT c, round(greatest(least((coalesce(sum(t) FILTER (WHERE is_text), 0) + {s.TEXT_CHANGE_RATE * s.PRIOR}) / (coalesce(sum(n - 1) FILTER (WHERE is_text), 0) + {s.PRIOR}), {s.MOST_RATE}), {s.LEAST_RATE}), 6) AS q FROM sorted_ GROUP BY c),
hit AS (SELECT rid, s, e, x.c, {tail} AS b FROM sorted_ x JOIN rates ON x.c = rates.c WHERE NOT is_text),
bars AS (SELECT h.c, min(h.b) AS b FROM (SELECT c, b, sum(count(*)) OVER (PARTITION BY c ORDER BY b DESC) AS r FROM hit GROUP BY c, b) h JOIN cnt ON h.c = cnt.c
         WHERE h.b > 0 AND power(2.0, -h.b / {float(s.GRID)}) <= {s.FDR} * h.r / cnt.m GROUP BY h.c),
added AS (SELECT hit.rid, hit.s, hit.e, 3 AS k, 'random' AS kind FROM hit JOIN bars ON hit.c = bars.c AND hit.b >= bars.b
          WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.rid = hit.rid AND base.s < hit.e AND hit.s < base.e)),
every AS (SELECT rid, s, e, k, kind FROM base UNION ALL SELECT * FROM added),
agg AS (SELECT rid, count(*) FILTER (WHERE k = 0) AS a0, count(*) FILTER (WHERE k = 1) AS a1, count(*) FILTER (WHERE k = 2) AS a2,
               string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (WHERE k < 3) AS b, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS x FROM every GROUP BY rid)
SELECT doc_id, coalesce(a0, 0) AS n_assign, coalesce(a1, 0) AS n_access, coalesce(a2, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(x, '') AS spans
FROM d LEFT JOIN agg ON d.rid = agg.rid
"""


def _op8_sql() -> str:
    kinds = licenses.kinds(licenses.TEMPLATES)
    rows = ", ".join(f"({kind.number}, {kind.k}, {kind.span}, '{name}', '{g}', {len(gs)})" for kind in kinds for name, gs in kind.templates.items() for g in gs)
    return rf"""
WITH t(class, k, span, license, g, n) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '{licenses.SEPARATORS}'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT rid, p - 1 AS p, k, array_to_string(w[p:p + k - 1], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS p FROM d), (SELECT DISTINCT k FROM t) x WHERE p + k - 1 <= len(w)),
hit AS (SELECT rid, class, license, sh.g, n, p, t.k, span FROM sh JOIN t ON sh.g = t.g AND sh.k = t.k),
win AS (SELECT rid, class, license, g, n, p // span AS win FROM hit UNION ALL SELECT rid, class, license, g, n, p // span - 1 FROM hit WHERE p + k <= (p // span + 1) * span),
ok AS (SELECT rid, license, win, count(DISTINCT g) / n AS c FROM win GROUP BY rid, license, win, n HAVING count(DISTINCT g) / n >= {licenses.MIN_CONTAINMENT}),
agg AS (SELECT rid, string_agg(DISTINCT license, ',' ORDER BY license) AS l, count(*) AS n, max(c) AS c FROM ok GROUP BY rid)
SELECT doc_id, coalesce(l, '') AS licenses, coalesce(n, 0) AS n_windows, coalesce(round(c, 6), 0.0) AS containment FROM d LEFT JOIN agg ON d.rid = agg.rid
"""


OP1_SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
      FROM v q, v c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
_GROUP = "CAST('0x' || substr(d, {0}, 8) AS BIGINT)"

OP11_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
u AS (SELECT *, regexp_extract_all(t, '{UNIT}') AS u FROM t),
n AS (SELECT *, CAST(len(u) AS BIGINT) AS n, {_GROUP.format(1)} % (len(u) + 1) AS x, {_GROUP.format(9)} % (len(u) + 1) AS y FROM u),
c AS (SELECT *, array_to_string(u[1:least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(u[greatest(x, y) + 1:], '') AS s,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {_GROUP.format(17)} % 100 >= 50 THEN 'plain' WHEN {_GROUP.format(25)} % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM n)
SELECT doc_id, n, form, CAST(CASE WHEN form <> 'plain' THEN length(p) END AS BIGINT) AS prefix_chars, CAST(CASE WHEN form <> 'plain' THEN length(m) END AS BIGINT) AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(p || m || s) AS restored_sha256 FROM c
"""


def _op13_sql(levels: int = 8, tops: int = 4) -> str:
    """SQL for trees of at most 8 ** levels leaves a language, and 8 ** tops languages."""
    part = lambda x: f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || {x}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(part, (*manifest.COLUMNS[:-1], text))) + ")"
    step = "list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: {step}), 4294967295)"
    lower = f"CASE WHEN {crc} % 3 = 0 THEN translate(text, '{manifest.UPPER}', '{manifest.LOWER}') ELSE text END"

    def climb(first: str, name: str, height: int) -> list[str]:
        """Levels of nodes (k, i, h, n) above a table of them, and each node's siblings."""
        out, below = [], first
        for level in range(height):
            w = "OVER (PARTITION BY k, i // 8 ORDER BY i ROWS BETWEEN"
            out.append(f"{name}_s{level} AS (SELECT k, i, coalesce(string_agg(h, '') {w} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') {w} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {below} WHERE n > 1)")
            out.append(f"{name}{level + 1} AS (SELECT k, i // 8 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h, (max(n) + 7) // 8 AS n FROM {below} WHERE n > 1 GROUP BY k, i // 8)")
            below = f"{name}{level + 1}"
        every = " UNION ALL ".join(f"SELECT k, h FROM {t} WHERE n = 1" for t in [first, *[f"{name}{x + 1}" for x in range(height)]])
        return [*out, f"{name}_roots AS ({every})"]

    joins, folds, told = "", [], []
    for k, (name, key, at) in enumerate([(f"a_s{x}", "o.k", f"o.i // {8**x}") for x in range(levels)] + [(f"b_s{x}", "0", f"g.i // {8**x}") for x in range(tops)]):
        joins += f" LEFT JOIN {name} s{k} ON s{k}.k = {key} AND s{k}.i = {at}"
        told.append(f"s{k}.l AS l{k}, s{k}.r AS r{k}")
        folds.append(f"f{k + 1} AS (SELECT *, CASE WHEN l{k} IS NULL THEN f{k} ELSE sha256(l{k} || f{k} || r{k}) END AS f{k + 1} FROM f{k})")
    last = levels + tops
    proof = " || ".join(f"coalesce(l{k} || r{k}, '')" for k in range(last))
    return f"""
WITH d AS (SELECT doc_id, coalesce('=' || lang, '') AS k, {leaf("text")} AS leaf, {leaf(f"({lower})")} AS other FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM d),
a0 AS (SELECT k, i, leaf AS h, n FROM o), {", ".join(climb("a0", "a", levels))},
g AS (SELECT k, h AS subroot, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n FROM a_roots),
b0 AS (SELECT 0 AS k, i, subroot AS h, n FROM g), {", ".join(climb("b0", "b", tops))},
f0 AS (SELECT doc_id, leaf, subroot, b_roots.h AS root, other AS f0, {", ".join(told)} FROM o JOIN g ON o.k = g.k CROSS JOIN b_roots{joins}),
{", ".join(folds)}
SELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, f{last} AS folded_root, f{last} = root AS verified FROM f{last}
"""


ORACLES = {"op1_topk": OP1_SQL, "op8_licenses": _op8_sql(), "op2_secret_scan": _op2_sql(), "op6_mixing": OP6_SQL, "op7_quality": OP7_SQL, "op11_fill_middle": OP11_SQL, "op13_manifest": _op13_sql()}
