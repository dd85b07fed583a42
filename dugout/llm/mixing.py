"""Mixing sources to target weights by iterative proportional fitting.

The corpus's tokens are summed by cell (source, language, topic). The cells' weights are raked: scaled in turn
so that each marginal meets its targets, round after round until they stand still. Of the wanted share of all
tokens each cell gives its weight, so a document's probability is its cell's wanted tokens over those there
are. No cell gives more than it has: what would is held at a probability of 1, while the other cells go on
being scaled to the targets. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from dugout.llm.common import col, forget, materialize, numbered, renamed

DIMENSIONS = ("source", "lang", "topic")
#: Without targets, a value's target is its share of the tokens raised to this power.
TEMPER = 0.7
#: The share of all tokens that the sample is to have.
KEPT = 0.4
#: Raking ends when no cell's share of the sample changes by more than this in a round, or after so many rounds.
STILL, ROUNDS = 1e-5, 30
NONE, OTHER = "(none)", "(other)"
#: Topics are words: so many, each in at most this share of its language's documents.
TOPICS, COMMON = 12, 0.2
#: The SQL still counts a sample of about so many documents, drawn by their ids: up to as many both count all.
TOPIC_ROWS = 4000
WORD = "[A-Za-z]{4,}"


def words(text: Column) -> Column:
    """The runs of four ASCII letters or more, in small letters."""
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower)


def topic_words(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> list[str]:
    """The words that name topics: of the words that are in few enough documents of their language, those in most, each
    language's first word before any language's second. All documents with a text and an id are counted; the driver gets
    ``TOPICS`` words."""
    language = F.coalesce(col(lang).cast("string"), F.lit(NONE)) if lang in docs.columns else F.lit(NONE)
    some = docs.filter(col(text).isNotNull() & col(id_col).isNotNull()).select(language.alias("lang"), col(text).alias("text"))
    # the empty word stands for the document itself, so that one pass gives both counts
    each = F.explode(F.array_append(F.array_distinct(words(F.col("text"))), F.lit("")))
    found = materialize(some.select("lang", each.alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n")), "topics")
    of = found.filter("word = ''").select("lang", F.col("n").alias("of"))
    found = found.filter("word <> ''").join(F.broadcast(of), "lang").filter(F.col("n") <= COMMON * F.col("of"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).filter(F.col("rank") <= TOPICS)
    best = ranked.groupBy("word").agg(F.min("rank").alias("rank"), F.max("n").alias("n")).orderBy("rank", F.desc("n"), "word")
    return [r["word"] for r in best.limit(TOPICS).collect()]


def topic(text: Column, named: Sequence[str]) -> Column:
    """The one of the words that the whole text has most often, ties to the first named."""
    if not named:
        return F.when(text.isNull(), NONE).otherwise(OTHER)
    own = F.filter(words(text), lambda w: w.isin(list(named)))

    def count(held: Column, place: int, word: str) -> Column:
        return F.struct(F.size(F.filter(held, lambda w: w == word)).alias("n"), F.lit(-place).alias("place"), F.lit(word).alias("word"))

    def counts(held: Column) -> Column:
        return F.greatest(*[count(held, i, w) for i, w in enumerate([*named, OTHER])])

    best = F.transform(F.array(own), counts)[0]
    return F.when(text.isNull(), NONE).when(best["n"] == 0, OTHER).otherwise(best["word"])


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\r\\n]+")), F.lit(0)).cast("long")


def draw(id_: Column, text: Column) -> Column:
    """A number in [0, 1) that depends on the id alone; on the text where the id is null."""
    digits = F.substring(F.md5(F.coalesce(id_.cast("string"), F.concat(F.lit("?"), F.coalesce(text, F.lit(""))))), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 32)


def tempered(cells: DataFrame, dimension: str, power: float = TEMPER) -> DataFrame:
    """Default targets of a dimension: value, and its share of the whole after tempering."""
    each = cells.groupBy(dimension).agg(F.pow(F.sum("tokens"), F.lit(power)).alias("part"))
    whole = each.agg(F.sum("part")).first()[0]
    return each.select(dimension, (F.col("part") / F.lit(whole or 1.0)).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, kept: float = KEPT) -> DataFrame:
    """Add ``weight``, a share of the sample, to cells (dimensions, tokens): their shares raked to the targets (dimension, target).

    Each round scales by every dimension once and is written to the shared folder. No weight exceeds the cell's
    share of all tokens over ``kept``. A value without a target, or with a target of 0, gets weight 0.
    """
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0) or 1.0
    weighed = cells.withColumn("_share", F.col("tokens") / F.lit(total)).withColumn("weight", F.col("_share"))
    goals = {d: f"_target{i}" for i, d in enumerate(targets)}
    for d, target in targets.items():
        weighed = weighed.join(target.select(d, F.col("target").alias(goals[d])), d, "left")
    weighed = materialize(weighed, "rake")
    for _ in range(rounds):
        before, seen = weighed, Observation()
        weighed = weighed.withColumn("_was", F.col("weight"))
        for d, goal in goals.items():
            now = F.sum("weight").over(Window.partitionBy(d))  # of a value's cells, which are few beside its documents
            scaled = F.when(now > 0, F.col("weight") * F.coalesce(goal, F.lit(0.0)) / now).otherwise(0.0)
            weighed = weighed.withColumn("weight", F.least(scaled, F.col("_share") / F.lit(kept)))
        weighed = materialize(weighed.observe(seen, F.max(F.abs(F.col("weight") - F.col("_was"))).alias("most")).drop("_was"), "rake")
        forget(before)
        if (seen.get["most"] or 0) <= STILL:
            break
    return weighed.select(*cells.columns, "weight")


def gap(raked: DataFrame, targets: dict[str, DataFrame]) -> float:
    """The greatest distance of a value's share of the sample from its target."""
    found = [
        raked.groupBy(d).agg(F.sum("weight").alias("now")).join(target, d).agg(F.max(F.abs(F.col("now") - F.col("target")))).first()[0]
        for d, target in targets.items()
    ]
    return max((x for x in found if x is not None), default=0.0)


def calibrate(
    docs: DataFrame, targets: dict[str, DataFrame] | None = None, id_col: str = "doc_id", text: str = "text",
    dimensions: Sequence[str] = DIMENSIONS, rounds: int = ROUNDS, keep: Sequence[str] | None = None, kept: float = KEPT,
) -> DataFrame:
    """Add n_tokens, topic, weight (the cell's share of the sample over its share of the tokens), probability and kept to every row.

    The dimension ``topic`` is the one of ``topic_words`` that a text has most often, learned from ``docs``; the
    others are columns. A null value of a dimension is a value of its own, ``(none)``. ``targets`` has one frame
    (dimension, target) for each dimension; without it the shares are tempered. The sample is to have the share
    ``kept`` of all tokens. A row is kept if the draw of its id (of its text, where the id is null) falls below its
    probability: repeated rows are kept or dropped together. Texts without words count no tokens; a cell of such texts
    only has weight 1 and probability ``kept``.
    """
    kept_columns = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("n_tokens", "topic", "weight", "probability", "kept")]
    named = topic_words(docs, id_col, text) if "topic" in dimensions else []
    marked = docs.select(
        *[col(c).alias(f"own{i}") for i, c in enumerate(kept_columns)],
        n_words(col(text)).alias("_tokens"),
        draw(col(id_col), col(text)).alias("_draw"),
        *[(topic(col(text), named) if d == "topic" else F.coalesce(col(d).cast("string"), F.lit(NONE))).alias(f"_{d}") for d in dimensions],
    )
    if keep is not None and text not in kept_columns:
        marked = materialize(marked, "marked")  # without the texts it is small, and the words are sought once
    keys = [f"_{d}" for d in dimensions]
    cells = materialize(marked.groupBy(*keys).agg(F.sum("_tokens").alias("tokens")), "cells")
    wanted = {
        f"_{d}": tempered(cells, f"_{d}") if targets is None else targets[d].select(col(d).cast("string").alias(f"_{d}"), F.col("target").cast("double"))
        for d in dimensions
    }
    raked = rake(cells, wanted, rounds, kept)
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    ratio = F.when(F.col("tokens") > 0, F.col("weight") * total / F.col("tokens")).otherwise(1.0)
    # small beside the documents, and written, so that Spark knows its size and can split the partition of a large cell
    ratios = materialize(raked.select(*keys, F.round(ratio, 6).alias("weight"), F.round(F.least(F.lit(1.0), ratio * kept), 6).alias("probability")), "ratios")
    joined = marked.join(ratios, keys)
    return joined.select(
        *[F.col(f"own{i}").alias(c) for i, c in enumerate(kept_columns)],
        F.col("_tokens").alias("n_tokens"),
        *([F.col("_topic").alias("topic")] if "topic" in dimensions else []),
        "weight",
        "probability",
        (F.col("_draw") < F.col("probability")).alias("kept"),
    )


def sample(
    docs: DataFrame, targets: dict[str, DataFrame] | None = None, id_col: str = "doc_id", text: str = "text",
    dimensions: Sequence[str] = DIMENSIONS, rounds: int = ROUNDS, kept: float = KEPT,
) -> DataFrame:
    """The rows of ``docs`` that ``calibrate`` keeps, with all columns as they were, whatever their names."""
    held, names = numbered(docs)
    held = held.select("*", *[F.col(names[d]).alias(d) for d in dimensions if d != "topic"])
    return renamed(calibrate(held, targets, names[id_col], names[text], dimensions, rounds, kept=kept).filter("kept"), names)


def oracle_sql(rounds: int = ROUNDS) -> str:
    """The same computation over ``documents`` in DuckDB's SQL, every round written out."""
    found = f"[lower(w) FOR w IN regexp_extract_all(text, '{WORD}')]"
    steps = [
        f"""sampled AS MATERIALIZED (SELECT coalesce(lang, '{NONE}') AS lang, {found} AS words FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
  AND CAST('0x' || substr(md5('topic ' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0
    < {TOPIC_ROWS} / greatest(1, (SELECT count(*) FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)))""",
        f"""ranked AS (SELECT word, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank FROM
  (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(list_distinct(words)) AS word FROM sampled) GROUP BY ALL)
  JOIN (SELECT lang, count(*) AS total FROM sampled GROUP BY lang) USING (lang) WHERE n <= {COMMON} * total)""",
        f"""named AS MATERIALIZED (SELECT word, row_number() OVER (ORDER BY rank, n DESC, word) AS place FROM
  (SELECT word, min(rank) AS rank, max(n) AS n FROM ranked WHERE rank <= {TOPICS} GROUP BY word) ORDER BY rank, n DESC, word LIMIT {TOPICS})""",
        """numbered AS MATERIALIZED (SELECT row_number() OVER () AS row, * FROM documents)""",
        f"""topics AS MATERIALIZED (SELECT row, arg_max(word, {{'n': n, 'place': -place}}) AS topic FROM
  (SELECT row, word, count(*) AS n FROM (SELECT row, unnest({found}) AS word FROM numbered) GROUP BY row, word)
  JOIN named USING (word) GROUP BY row)""",
        f"""marked AS MATERIALIZED (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang,
  CASE WHEN text IS NULL THEN '{NONE}' ELSE coalesce(t.topic, '{OTHER}') END AS topic,
  coalesce(len(regexp_extract_all(text, '[^ \\t\\r\\n]+')), 0) AS n_tokens,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '?' || coalesce(text, ''))), 1, 8) AS BIGINT) / 4294967296.0 AS draw
  FROM numbered LEFT JOIN topics t USING (row))""",
        """w0 AS MATERIALIZED (SELECT *, tokens / greatest((SELECT sum(n_tokens) FROM marked), 1) AS share, tokens / greatest((SELECT sum(n_tokens) FROM marked), 1) AS weight
  FROM (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM marked GROUP BY ALL))""",
    ]
    for d in DIMENSIONS:
        steps.append(f"part_{d} AS (SELECT {d}, pow(sum(tokens), {TEMPER}) AS part FROM w0 GROUP BY {d})")
        steps.append(f"target_{d} AS MATERIALIZED (SELECT {d}, part / (SELECT sum(part) FROM part_{d}) AS target FROM part_{d})")
    n = 0
    for _ in range(rounds):
        for d in DIMENSIONS:
            steps.append(
                f"""w{n + 1} AS MATERIALIZED (SELECT w.source, w.lang, w.topic, w.tokens, w.share,
  least(CASE WHEN s.now > 0 THEN w.weight * t.target / s.now ELSE 0 END, w.share / {KEPT}) AS weight FROM w{n} w
  JOIN (SELECT {d}, sum(weight) AS now FROM w{n} GROUP BY {d}) s USING ({d}) JOIN target_{d} t USING ({d}))"""
            )
            n += 1
    each = len(DIMENSIONS)
    for k in range(1, rounds + 1):
        moved = f"SELECT max(abs(a.weight - b.weight)) FROM w{k * each} a JOIN w{(k - 1) * each} b USING (source, lang, topic)"
        steps.append(f"moved{k} AS MATERIALIZED (SELECT {k} AS k, ({moved}) AS most)")
    steps.append(f"still AS MATERIALIZED (SELECT coalesce(min(k), {rounds}) AS k FROM ({' UNION ALL '.join(f'FROM moved{k}' for k in range(1, rounds + 1))}) WHERE coalesce(most, 0) <= {STILL})")
    steps.append("raked AS (" + " UNION ALL ".join(f"SELECT * FROM w{k * each} WHERE (SELECT k FROM still) = {k}" for k in range(1, rounds + 1)) + ")")
    steps.append("ratios AS (SELECT *, CASE WHEN tokens > 0 THEN weight / share ELSE 1 END AS ratio FROM raked)")
    return f"""WITH {", ".join(steps)},
final AS (SELECT source, lang, topic, round(ratio, 6) AS weight, round(least(1.0, ratio * {KEPT}), 6) AS probability FROM ratios)
SELECT doc_id, source, lang, topic, CAST(n_tokens AS BIGINT) AS n_tokens, weight, probability, draw < probability AS kept
FROM marked JOIN final USING (source, lang, topic)"""
