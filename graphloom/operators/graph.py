"""Graph operators: upsert, deduplication, one-hop expansion, and the exact, fuzzy, substring cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import clean_name, label_of, strip

FUZZY_MIN = 0.5


def _first(df: DataFrame, keys: list, seq: str) -> DataFrame:
    """The first row by seq of each key: an aggregate with partial results, so a frequent key does not gather in one task."""
    order = F.struct(F.col(seq), F.struct(*df.columns))
    return df.groupBy(*[k.alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.min(order).alias("r")).select("r.col2.*")


def dedup_entities(df: DataFrame, seq: str = "seq", within: list[str] = []) -> DataFrame:  # noqa: B006
    """Keeps the first row of each stripped (id, type, role) as it is, in each group of the columns within; blank ids are left out."""
    blank = lambda c: strip(F.coalesce(c, F.lit("")))
    return _first(df.filter(F.length(blank("id")) > 0), [*map(F.col, within), *[blank(c) for c in ("id", "entity_type", "entity_role")]], seq)


def dedup_edges(df: DataFrame, seq: str = "seq", within: list[str] = []) -> DataFrame:  # noqa: B006
    return _first(df, [F.col(c) for c in (*within, "source", "target", "rel_type")], seq)


def clean_entities(df: DataFrame) -> DataFrame:
    return df.withColumns({c: clean_name(F.col(c)) for c in ("id", "entity_type", "entity_role")})


def valid_nodes(df: DataFrame) -> DataFrame:
    """Rows with an id and a type that is more than underscores, with the type's label."""
    label = label_of(strip(F.col("entity_type")))
    return df.filter((F.length(strip(F.coalesce("id", F.lit("")))) > 0) & (F.length(F.translate(label, "_", "")) > 0)).withColumn("label", label)


def upsert_nodes(old: DataFrame, new: DataFrame, seq: str = "seq") -> DataFrame:
    """Entities after the valid rows of new: the last row of an id sets type and role, labels accumulate."""
    rows = valid_nodes(new).select(strip(F.col("id")).alias("id"), "entity_type", F.coalesce("entity_role", F.lit("")).alias("entity_role"), F.array(F.lit("Entity"), "label").alias("labels"), F.col(seq).cast("long").alias("seq"))
    both = old.select("id", "entity_type", "entity_role", "labels", F.lit(-1).cast("long").alias("seq")).unionByName(rows)
    last = F.max_by(F.struct("entity_type", "entity_role"), F.struct("seq", "entity_type", "entity_role")).alias("p")
    kinds = F.array_sort(F.array_except(F.array_distinct(F.flatten(F.collect_set("labels"))), F.array(F.lit("Entity"))))
    return both.groupBy("id").agg(last, kinds.alias("kinds")).select("id", "p.entity_type", "p.entity_role", F.concat(F.array(F.lit("Entity")), "kinds").alias("labels"))


def valid_edges(df: DataFrame) -> DataFrame:
    """Edges with two different, non-blank ends and a usable type, the ends stripped and the type as a label."""
    s, t, r = (F.coalesce(c, F.lit("")) for c in ("source", "target", "rel_type"))
    label = label_of(strip(r))
    ok = (s != t) & (F.length(strip(s)) > 0) & (F.length(strip(t)) > 0) & (F.length(strip(r)) > 0) & (strip(r) != "-") & ~label.isin("", "_")
    return df.filter(ok).select(strip(s).alias("source"), strip(t).alias("target"), label.alias("rel_type"))


def between(edges: DataFrame, entities: DataFrame, tasks: int | None = None) -> DataFrame:
    """The edges whose ends are both entities. tasks: over how many tasks many edges and entities are dealt, in place of
    the session's setting; no table of ids is then sent to every task. A task holds its share of the ids, which are once each,
    and the edges pass by them unsorted, so an end that many edges share takes no more memory."""
    ids = entities.select("id")
    if not tasks:
        return edges.join(ids, edges["source"] == ids["id"], "left_semi").join(ids, edges["target"] == ids["id"], "left_semi")
    once = ids.repartition(tasks, "id").distinct().withColumnRenamed("id", "_id").hint("shuffle_hash")  # a semi-join would move below the exchange of the edges
    for end in ("source", "target"):
        edges = edges.repartition(tasks, end).join(once, F.col(end) == F.col("_id")).drop("_id")
    return edges


def upsert_edges(old: DataFrame, new: DataFrame, entities: DataFrame) -> DataFrame:
    return old.select("source", "target", "rel_type").union(between(valid_edges(new), entities)).distinct()


def expand(matched: DataFrame, entities: DataFrame, edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """One hop in both directions from the matched rows (id, entity_role, type, and more): the matched node is the source.
    Each edge is read once and given both its directions; it meets the matched rows, which are few, before the other ends.
    Where they are many, tasks says over how many the rows are dealt, as for between(), and the other ends come first: the
    triples then lie by their source, and a count by source needs no exchange of the session's setting."""
    here = F.struct(F.col("source").alias("s"), F.col("target").alias("t"))
    there = F.struct(F.col("target").alias("s"), F.col("source").alias("t"))
    ways = F.when(F.col("source") == F.col("target"), F.array(here)).otherwise(F.array(here, there))
    both = edges.select(F.explode(ways).alias("w"), F.col("rel_type").alias("relationship")).select("w.s", "w.t", "relationship")
    ends = entities.select(F.col("id").alias("t"), F.col("entity_role").alias("target_role"), F.element_at("labels", 1).alias("target_type"))
    if tasks:
        met = both.repartition(tasks, "t").join(ends.hint("shuffle_hash"), "t").repartition(tasks, "s").join(matched.hint("shuffle_hash"), F.col("s") == F.col("id"))
    else:
        met = both.join(matched, both["s"] == matched["id"]).join(ends, "t")
    return met.select(
        F.col("id").alias("source_id"), F.col("entity_role").alias("source_role"), F.element_at("labels", 1).alias("source_type"), "relationship",
        F.col("t").alias("target_id"), "target_role", "target_type", *[c for c in matched.columns if c not in entities.columns],
    )


def without(triples: DataFrame, excluded: list[str]) -> DataFrame:
    """The triples none of whose ends has an excluded id or role (case ignored)."""
    names = [x.lower() for x in excluded]
    if not names:
        return triples
    ok = F.lit(True)
    for c in ("source_id", "source_role", "target_id", "target_role"):
        ok &= ~F.lower(F.coalesce(c, F.lit(""))).isin(names)
    return triples.filter(ok)


TRIPLE = ["source_id", "source_role", "source_type", "relationship", "target_id", "target_role", "target_type"]


def _found(entities: DataFrame, condition: Column, edges: DataFrame, excluded: list[str], limit: int) -> DataFrame:
    return without(expand(entities.filter(condition), entities, edges), excluded).select(*TRIPLE).distinct().orderBy("source_id", "relationship", "target_id").limit(limit)


def exact(entities: DataFrame, edges: DataFrame, names: list[str], excluded: list[str] = [], limit: int = 10) -> DataFrame:  # noqa: B006
    """Triples around the entities whose id or role is one of the names, case ignored."""
    return _found(entities, _named(names), edges, excluded, limit)


def _named(names: list[str]) -> Column:
    low = [n.lower() for n in names]
    return F.lower("id").isin(low) | F.lower("entity_role").isin(low)


def _near(names: list[str]) -> Column:
    near = F.lit(False)
    for n in names:
        near |= fuzzy_score(F.col("id"), n) >= FUZZY_MIN
    return near


def contains(entities: DataFrame, edges: DataFrame, names: list[str], excluded: list[str] = [], limit: int = 10) -> DataFrame:  # noqa: B006
    """Triples around the entities whose id or role holds one of the names, case ignored."""
    hit = F.lit(False)
    for n in names:
        hit |= F.contains(F.lower("id"), F.lit(n.lower())) | F.contains(F.lower(F.coalesce("entity_role", F.lit(""))), F.lit(n.lower()))
    return _found(entities, hit, edges, excluded, limit)


def one_edit(x: Column, y: str) -> Column:
    """Whether x and y differ by one insertion, deletion, replacement or swap of neighbours at most."""
    swapped = sorted({y[:i] + y[i + 1] + y[i] + y[i + 2 :] for i in range(len(y) - 1)})
    near = F.levenshtein(x, F.lit(y), 1).between(0, 1)
    return near | x.isin(swapped) if swapped else near


def fuzzy_score(id_: Column, name: str) -> Column:
    """1 where a token of the id starts with the name's last word or equals another of its words, less for one edit."""
    words = name.lower().split()
    if not words:
        return F.lit(0.0)
    last, rest = words[-1], words[:-1]
    near = 1.0 - 1.0 / len(last)
    score = lambda t: F.when(t.startswith(last) | (t.isin(rest) if rest else F.lit(False)), 1.0).when(one_edit(t, last), near).otherwise(0.0)
    return F.coalesce(F.array_max(F.transform(F.split(F.lower(id_), "[^\\p{L}\\p{N}_]+"), score)), F.lit(0.0))


def token_index(entities: DataFrame) -> DataFrame:
    """token, length and id: each token of an id once. Stored by token, with its deletion keys beside it
    (sources.index.save_tokens), it is the full-text index that fuzzy() reads."""
    tokens = F.array_distinct(F.array_remove(F.split(F.lower("id"), "[^\\p{L}\\p{N}_]+"), ""))
    return entities.select("id", F.explode(tokens).alias("token")).select("token", F.length("token").alias("length"), "id")


def deletion_keys(tokens: DataFrame) -> DataFrame:
    """key and token: each token under itself and under each of its spellings that lack one letter. Two tokens that differ by
    one insertion, deletion, replacement or swap of neighbours have a key in common, so one edit is an equality of keys."""
    places = F.sequence(F.lit(1), F.length("token"))
    without_one = F.transform(places, lambda i: F.concat(F.substring("token", 1, i - 1), F.substr(F.col("token"), i + 1)))
    keys = F.array_distinct(F.concat(F.array("token"), without_one))
    return tokens.select("token").distinct().select(F.explode(keys).alias("key"), "token")


def keys_of(word: str) -> list[str]:
    """The keys of a word, as deletion_keys() has them."""
    return list(dict.fromkeys([word, *(word[:i] + word[i + 1 :] for i in range(len(word)))]))


#: Values of an IN that a Parquet scan is handed one by one (more become one range from the least to the greatest).
PUSHED = 10
#: Tokens near the names that are put into the postings' filter as literals; more are joined.
LITERALS = 1000


def among(column: str, values: list[str]) -> Column:
    """column IN values, in parts that a scan can be handed whole."""
    found = F.lit(False)
    for i in range(0, len(values), PUSHED):
        found |= F.col(column).isin(values[i : i + PUSHED])
    return found


def near_tokens(index: dict[str, DataFrame], names: list[str]) -> DataFrame:
    """id, n (the name's place in names) and score of the entities with a token near a name. index: postings (token_index())
    and keys (deletion_keys()), each stored in the order of its first column. Tokens within one edit are found by equal keys;
    these, equal tokens and prefixes are equalities and ranges of the postings, which the scan's statistics skip to."""
    words = [(i, w[-1], w[:-1]) for i, w in enumerate(n.lower().split() for n in names) if w]
    postings, keys = index["postings"], index["keys"]
    if not words:
        return postings.select("id", F.lit(0).alias("n"), F.lit(0.0).alias("score")).filter("false")
    close = F.lit(False)
    for _, last, _ in words:
        close |= F.col("key").isin(keys_of(last)[:1]) | one_edit(F.col("token"), last)
    near = keys.filter(among("key", sorted({k for _, last, _ in words for k in keys_of(last)}))).filter(close).select("token").distinct()
    few = [r.token for r in near.limit(LITERALS + 1).collect()]
    plain = among("token", sorted({x for _, _, rest in words for x in rest}))
    for _, last, _ in words:
        plain |= F.col("token").startswith(last)
    if len(few) <= LITERALS:
        rows = postings.filter(plain | among("token", sorted(few)))
    else:
        rows = postings.filter(plain).unionByName(postings.filter(~plain).join(near, "token", "left_semi"))
    scores = []
    for i, last, rest in words:
        whole = F.col("token").startswith(last) | (F.col("token").isin(rest) if rest else F.lit(False))
        score = F.when(whole, 1.0).when(one_edit(F.col("token"), last), 1.0 - 1.0 / len(last))
        scores.append(F.struct(F.lit(i).alias("n"), score.alias("score")))
    each = rows.select("id", F.explode(F.filter(F.array(*scores), lambda x: x["score"].isNotNull())).alias("m"))
    return each.groupBy("id", "m.n").agg(F.max("m.score").alias("score"))


def fuzzy(entities: DataFrame, edges: DataFrame, names: list[str], excluded: list[str] = [], limit: int = 10, least: float = FUZZY_MIN, tokens: dict[str, DataFrame] | None = None) -> DataFrame:  # noqa: B006
    """Triples around entities with a token near a name: at most limit per name by score, each triple once, limit in all.
    tokens: a stored token index (sources.index.load_tokens), without which the ids' tokens are scanned."""
    if tokens is not None and names:
        found = near_tokens(tokens, names).filter(F.col("score") >= least)
        return _ranked_fuzzy(entities.join(found, "id").select(*entities.columns, "n", "score"), entities, edges, excluded, limit)
    scores = F.array(*[F.struct(F.lit(i).alias("n"), fuzzy_score(F.col("id"), x).alias("score")) for i, x in enumerate(names)])
    hits = entities.select("*", F.explode(scores).alias("m")).select(*entities.columns, "m.n", "m.score").filter(F.col("score") >= least)
    return _ranked_fuzzy(hits, entities, edges, excluded, limit)


def _ranked_fuzzy(hits: DataFrame, entities: DataFrame, edges: DataFrame, excluded: list[str], limit: int) -> DataFrame:
    found = without(expand(hits, entities, edges), excluded).distinct()
    order = Window.partitionBy("n").orderBy(F.desc("score"), "source_id", "relationship", "target_id")
    top = found.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= limit)
    once = Window.partitionBy("source_id", "relationship", "target_id").orderBy("n", "k")
    return top.withColumn("o", F.row_number().over(once)).filter("o = 1").orderBy("n", "k").limit(limit).select(*TRIPLE, "score")


def cascade(entities: DataFrame, edges: DataFrame, names: list[str], excluded: list[str] = [], limit: int = 10) -> DataFrame:  # noqa: B006
    """The first of exact, fuzzy and substring search that finds anything; later ones run only if needed. A search that no
    entity meets has no triples, so it is passed over without reading the edges."""
    if not names:
        return exact(entities, edges, ["\0"], [], 1).filter("false")
    schema = None
    for search, met in ((exact, _named), (fuzzy, _near)):
        if entities.filter(met(names)).isEmpty():
            continue
        found = search(entities, edges, names, excluded, limit).select(*TRIPLE)
        rows = found.collect()  # limit rows at most, asked for by the caller
        if rows:
            return entities.sparkSession.createDataFrame(rows, found.schema)
    return contains(entities, edges, names, excluded, limit)
