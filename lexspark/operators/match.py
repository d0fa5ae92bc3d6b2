"""From a table of queries to phrase hits.

`hits` is the one core relation: (query_id, concept, phrase, plen, id_tesis,
dl, col, starts), where `starts` are the token positions at which the phrase
begins in that column of that document. OR, AND, scopes, proximity and score
are aggregates over it.

A phrase is looked up by its rarest token. Only the documents that hold this
one are asked for the other tokens, so "derecho a la salud" never gathers the
postings of "a" and "la".
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexspark.functions.text import contains_folded, fold, tokens
from lexspark.session import durable, local_table, one_of, small_rows

PHRASE = ("query_id", "concept", "phrase")
# What every hit carries of its query. `n` is the document frequency where it is
# known beforehand: of a word, in the searched column.
ASKED = (*PHRASE, "n_concepts", "distancia", "buscar_en", "plen", "n")
_HIT = (*ASKED, "id_tesis", "dl", "col", "starts")
# Tokens up to which a query table is pushed to the scan as an IN list.
PUSHED_TOKENS = 500
# Beyond the size that is broadcast: so many of the most frequent tokens are
# dealt out over so many salts.
HOT_TOKENS = 1000
MAX_SALTS = 256
# Rows up to which phrases that are no local relation are broadcast all the same (some
# 40 MB): the postings then stay in their buckets.
BROADCAST_TERMS = 200_000


def salted_join(many: DataFrame, few: DataFrame, keys: list[str], spread: str,
                hot: Column | None = None) -> DataFrame:
    """Equi-join in which one key may hold a large part of `many`.

    Rows of `many` are dealt out by `spread`, rows of `few` copied to every salt;
    with `hot`, a condition on the keys, only for the keys it names.
    """
    salts = min(MAX_SALTS, int(many.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    if hot is not None:
        dealt = F.when(hot, dealt).otherwise(0)
        every = F.when(hot, every).otherwise(F.array(F.lit(0)))
    return (
        many.withColumn("salt", dealt)
        .join(few.withColumn("salt", F.explode(every)), [*keys, "salt"])
        .drop("salt")
    )


def query_phrases(queries: DataFrame) -> DataFrame:
    """One row per phrase of each concept, with its tokens `tk`.

    `n_concepts` counts the concepts given, so that a concept left without tokens
    makes an AND empty.
    """
    return (
        queries.select(
            "query_id", "buscar_en", "distancia",
            F.size("concepts").alias("n_concepts"),
            F.posexplode("concepts").alias("concept", "phrases"),
        )
        .select(
            "query_id", "buscar_en", "distancia", "n_concepts", "concept",
            F.posexplode("phrases").alias("phrase", "text"),
        )
        .withColumn("tk", tokens(F.col("text")))
        .select(
            "query_id", "buscar_en", "distancia", "n_concepts", "concept", "phrase",
            F.size("tk").alias("plen"), "tk",
        )
    )


def query_terms(queries: DataFrame) -> DataFrame:
    """One row per token of each phrase of each concept; a phrase without tokens has no row."""
    phrases = query_phrases(queries)
    return phrases.select(*[c for c in phrases.columns if c != "tk"], F.posexplode("tk").alias("off", "tok"))


def phrase_lookups(terms: DataFrame) -> DataFrame:
    """One row per phrase: its rarest token `tok` at `off`, and the `others`.

    `terms` carries `n`, the document frequency of each token in the searched
    column. A phrase with a token that no document holds is left out.
    """
    keys = [c for c in ASKED if c != "n"]
    ordered = F.sort_array(F.collect_list(F.struct("n", "off", "tok")))
    return (
        terms.groupBy(*keys).agg(ordered.alias("t"))
        .filter(F.size("t") == F.col("plen"))
        .select(
            *keys,
            F.when(F.col("plen") == 1, F.col("t")[0].n).alias("n"),
            F.col("t")[0].n.alias("most"),
            F.col("t")[0].tok.alias("tok"),
            F.col("t")[0].off.alias("off"),
            F.transform(F.slice("t", 2, F.size("t")), lambda x: F.struct(x.tok, x.off)).alias("others"),
        )
    )


@dataclass(frozen=True)
class Lookups:
    """The phrases of a query table, ready to be looked up in an index.

    Up to a checked size they are a local relation that is broadcast, their
    tokens a pushed-down list. Beyond, they are joined, frequent tokens salted.
    """

    rows: DataFrame
    small: bool
    tokens: list[str] | None  # to push down
    hot: list[str]  # to salt
    has_words: bool
    has_phrases: bool
    has_near: bool
    all_near: bool
    most: int | None  # bound on the documents of a query
    broadcast: bool = False  # no local relation, but not too large to be broadcast

    @staticmethod
    def of(queries: DataFrame, term_stats: DataFrame) -> "Lookups":
        terms = query_terms(queries)
        known = small_rows(terms)
        scoped = (
            F.when(F.col("buscar_en") == "rubro", F.col("df_rubro"))
            .when(F.col("buscar_en") == "texto", F.col("df_texto"))
            .otherwise(F.col("df"))
        )
        if known is None and terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
            counted = term_stats.join(F.broadcast(terms), "tok")
            rows = durable(phrase_lookups(counted.withColumn("n", scoped).filter("n > 0")))
            several = bool(terms.filter("plen > 1").head(1))
            near = bool(terms.filter("distancia is not null").head(1))
            return Lookups(rows, False, None, [], True, several, near, False, None, True)
        if known is None:
            hot = [r.tok for r in term_stats.orderBy(F.col("df").desc()).limit(HOT_TOKENS).collect()]
            counted = salted_join(terms, term_stats, ["tok"], "query_id", one_of("tok", hot))
            rows = phrase_lookups(counted.withColumn("n", scoped).filter("n > 0"))
            several = bool(terms.filter("plen > 1").head(1))
            near = bool(terms.filter("distancia is not null").head(1))
            return Lookups(rows, False, None, hot, True, several, near, False, None)

        asked = sorted({r.tok for r in known})
        local = local_table(queries.sparkSession, known, terms.schema)
        stats = term_stats.filter(one_of("tok", asked))
        lookups = phrase_lookups(
            stats.join(F.broadcast(local), "tok").withColumn("n", scoped).filter("n > 0")
        )
        rows = lookups.collect()  # at most one row per known term
        held = {r.tok for r in rows} | {o.tok for r in rows for o in r.others}
        return Lookups(
            rows=local_table(queries.sparkSession, rows, lookups.schema),
            small=True,
            tokens=sorted(held) if len(held) <= PUSHED_TOKENS else None,
            hot=[],
            has_words=any(r.plen == 1 for r in rows),
            has_phrases=any(r.plen > 1 for r in rows),
            has_near=any(r.distancia is not None for r in rows),
            all_near=bool(rows) and all(r.distancia is not None for r in rows),
            most=_most_documents(rows),
        )

    def of_phrases(self) -> "Lookups":
        """Only the phrases of several tokens. They may be few enough to be broadcast where the
        words are not."""
        rows = self.rows.filter("plen > 1")
        if self.small or self.broadcast:
            return replace(self, rows=rows, has_words=False)
        rows = durable(rows)
        few = rows.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
        return replace(self, rows=rows, has_words=False, broadcast=few)

    def with_other_tokens(self, posts: DataFrame, rows: DataFrame) -> DataFrame:
        """Postings of the tokens that these phrases have besides the one they are looked up by."""
        posts = self.pushed_down(posts)
        if self.tokens is not None or not (self.small or self.broadcast):
            return posts
        others = rows.select(F.explode("others").alias("o")).select("o.tok").distinct()
        return posts.join(F.broadcast(others), "tok", "left_semi")

    def pushed_down(self, posts: DataFrame) -> DataFrame:
        return posts if self.tokens is None else posts.filter(one_of("tok", self.tokens))

    def join_first_token(self, posts: DataFrame, rows: DataFrame, spread: str = "id_tesis") -> DataFrame:
        """Postings of the token each of these phrases is looked up by."""
        if self.small or self.broadcast:
            return self.pushed_down(posts).join(F.broadcast(rows), "tok")
        return salted_join(posts, rows, ["tok"], spread, one_of("tok", self.hot))

    def join_phrases(self, rows: DataFrame, per_phrase: DataFrame) -> DataFrame:
        """Add one value per phrase, if there is one, to rows keyed by phrase and document."""
        if self.small or self.broadcast:
            return rows.join(F.broadcast(per_phrase), list(PHRASE), "left")
        without, with_ = rows.filter("plen = 1"), rows.filter("plen > 1")
        value = [f for f in per_phrase.schema if f.name not in PHRASE][0]
        return salted_join(with_, per_phrase, list(PHRASE), "id_tesis").unionByName(
            without.withColumn(value.name, F.lit(None).cast(value.dataType))
        )


def _most_documents(rows: list) -> int:
    """Bound on the documents any one query matches, from its rarest tokens."""
    concepts: dict = {}
    for r in rows:
        key = (r.query_id, r.concept)
        concepts[key] = concepts.get(key, 0) + r.most
    queries: dict = {}
    for (query_id, _), n in concepts.items():
        queries[query_id] = min(n, queries.get(query_id, n))
    return sum(queries.values())


def _in_scope() -> Column:
    return (F.col("buscar_en") == "todo") | (F.col("buscar_en") == F.col("col"))


def word_hits(posts: DataFrame, lookups: Lookups) -> DataFrame:
    """Phrases of one token: a posting is the hit."""
    return (
        lookups.join_first_token(posts, lookups.rows.filter("plen = 1"))
        .filter(_in_scope())
        .withColumnRenamed("pos", "starts")
        .select(*_HIT)
    )


def phrase_hits(posts: DataFrame, lookups: Lookups, shortest: int = 1) -> DataFrame:
    """Phrases of so many tokens or more: all in one column, positions lined up.

    The other tokens are joined for the candidates only, on (document, column,
    token): keys without hot values, co-located in the stored index. Positions
    are then compared by set intersection inside the row. The group is one
    phrase in one column of one document.
    """
    keys = [c for c in _HIT if c != "starts"]
    phrases = lookups.rows.filter(F.col("plen") >= shortest)
    candidates = (
        lookups.join_first_token(posts, phrases)
        .filter(_in_scope())
        .withColumn("begin", F.transform("pos", lambda p: p - F.col("off")))
        .select(*keys, "begin", F.explode_outer("others").alias("other"))
        .select(*keys, "begin", F.col("other.tok").alias("tok"), F.col("other.off").alias("off"))
    )
    parts = (
        candidates.join(
            lookups.with_other_tokens(posts, phrases).select("id_tesis", "col", "tok", "pos"),
            ["id_tesis", "col", "tok"], "left",
        )
        .groupBy(*keys)
        .agg(
            F.first("begin").alias("begin"),
            F.collect_list(F.transform("pos", lambda p: p - F.col("off"))).alias("parts"),
        )
        .filter(F.size("parts") == F.col("plen") - 1)
    )
    starts = F.aggregate("parts", F.col("begin"), lambda acc, x: F.array_intersect(acc, x))
    # Exploding the one list drops empty ones without computing it twice.
    found = F.filter(F.array(F.sort_array(starts)), lambda s: F.size(s) > 0)
    return parts.withColumn("starts", F.explode(found)).select(*_HIT)


def hits(posts: DataFrame, lookups: Lookups) -> DataFrame:
    """All phrase instances, before any proximity rule."""
    return phrase_hits(posts, lookups) if lookups.has_phrases else word_hits(posts, lookups)


def near_hits(found: DataFrame) -> DataFrame:
    """Keep the instances that take part in a near pair of two phrases.

    Two instances are near if at most N tokens lie between the end of the first
    and the start of the second, in one column, in either order. The closest
    neighbour on each side decides, so a running maximum and minimum over the
    ordered positions replaces any pairing: linear in the number of instances.
    """
    place = W.partitionBy("query_id", "id_tesis", "col")
    forward = place.orderBy("start")
    backward = place.orderBy(F.col("start").desc())

    def side(concept: int, value: Column) -> Column:
        return F.when(F.col("concept") == concept, value)

    start, end = F.col("start"), F.col("start") + F.col("plen")
    other = F.when(F.col("concept") == 0, F.lit(1)).otherwise(F.lit(0))
    # End of the closest instance of the other phrase that starts here or before ...
    before = F.when(other == 1, F.max(side(1, end)).over(forward)).otherwise(
        F.max(side(0, end)).over(forward)
    )
    # ... and start of the closest one that starts here or after.
    after = F.when(other == 1, F.min(side(1, start)).over(backward)).otherwise(
        F.min(side(0, start)).over(backward)
    )
    gap = F.least(start - before, after - end)  # NULL sides are skipped
    keys = [c for c in _HIT if c != "starts"]
    return (
        found.withColumn("start", F.explode("starts")).drop("starts")
        .withColumn("gap", gap)
        .filter(F.col("gap") <= F.col("distancia"))
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list("start")).alias("starts"))
        .select(*_HIT)
    )


def matching_hits(found: DataFrame, lookups: Lookups) -> DataFrame:
    """Hits after the proximity rule of the queries that have one."""
    if not lookups.has_near:
        return found
    near = near_hits(found.filter(F.col("distancia").isNotNull()))
    return near if lookups.all_near else near.unionByName(found.filter(F.col("distancia").isNull()))


def with_all_concepts(rows: DataFrame, *sums: Column, document: tuple[str, ...] = ("id_tesis",)) -> DataFrame:
    """Documents per query in which every concept of the query occurs, with sums over
    the rows; `document` names their key. Rows are first brought to one per concept, so any number of concepts
    counts; a column summed must be an integer, of any order of addition."""
    names = [f"s{n}" for n in range(len(sums))]
    each = rows.groupBy("query_id", *document, "concept").agg(
        F.first("n_concepts").alias("n_concepts"), *[F.sum(c).alias(n) for c, n in zip(sums, names)])
    return (
        each.groupBy("query_id", *document)
        .agg(F.count("*").alias("held"), F.first("n_concepts").alias("n_concepts"), *[F.sum(n).alias(n) for n in names])
        .filter("held = n_concepts").select("query_id", *document, *names)
    )


def matches(found: DataFrame) -> DataFrame:
    """Documents per query that satisfy all its concepts."""
    return with_all_concepts(found)


# -- without an index -------------------------------------------------------

CONTRADICTION = ("contradiccion de tesis", "contradiccion de criterios")


def mentions_contradiction() -> Column:
    """A contradiction is named in the title, the body or the precedents."""
    pattern = F.lit(r"(?s)contradicci.*de (tesis|criterios)")
    columns = [F.coalesce(F.regexp_like(fold(F.col(c)), pattern), F.lit(False)) for c in ("rubro", "texto", "precedentes")]
    return reduce(lambda a, b: a | b, columns)


SCANNED = {"todo": ("texto", "rubro"), "texto": ("texto",), "rubro": ("rubro",)}


def scan_condition(concepts: list[list[str]], scope: str = "todo") -> Column:
    """Every concept has a term that occurs as a substring of title or body."""
    columns = SCANNED[scope]

    def has(term: str) -> Column:
        tests = [contains_folded(F.col(c), F.lit(term.strip())) for c in columns]
        return reduce(lambda a, b: a | b, tests)

    alternatives = [reduce(lambda a, b: a | b, map(has, concept)) for concept in concepts]
    return reduce(lambda a, b: a & b, alternatives)
