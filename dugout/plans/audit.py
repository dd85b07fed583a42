"""Data quality: agreement with another source's fields, of fielding credits as multisets, and an audit of the grammar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dugout.functions.columns import count_if, rate
from dugout.functions.events import once, parse_events, unparsed_advances

SAMPLES, TOP = 15, 20


def mismatches(ours: DataFrame, theirs: DataFrame, keys: list[str], field: str, samples: int = SAMPLES) -> DataFrame:
    """A few rows, by key, in which a field differs: the keys, and both values."""
    both = ours.select(*keys, F.col(field).alias("ours")).join(theirs.select(*keys, F.col(field).alias("theirs")), keys)
    return both.filter(~F.col("ours").eqNullSafe(F.col("theirs"))).orderBy(*keys).limit(samples)


def multiset_parity(ours: DataFrame, theirs: DataFrame, keys: list[str], kind: str = "kind", value: str = "position") -> DataFrame:
    """For each kind of credit, the keys whose values agree in whatever order, out of all keys that either side has."""
    bag = lambda df, name: df.groupBy(*keys, kind).agg(F.array_sort(F.collect_list(value)).alias(name))
    both = bag(ours, "a").join(bag(theirs, "b"), [*keys, kind], "full")
    sums = both.groupBy(kind).agg(F.count("*").alias("compared"), count_if(F.col("a").eqNullSafe(F.col("b"))).alias("equal"))
    return sums.withColumn("share", rate("equal", "compared", 6))


def grammar_audit(play: DataFrame) -> DataFrame:
    """One row: plays, and those of unknown events and with outs beyond three, with their shares in percent."""
    unknown, beyond = F.col("event_code").isNull() | (F.col("event_code") == 0), F.col("outs_before") + F.col("outs_on_play") > 3
    sums = play.agg(F.count("*").alias("plays"), count_if(unknown).alias("unknown_event"), count_if(beyond).alias("outs_overflow"))
    return sums.withColumns({f"pct_{c}": rate(c, "plays", 4, 100) for c in ("unknown_event", "outs_overflow")})


def unknown_events(play: DataFrame, top: int = TOP) -> DataFrame:
    """The commonest event strings that the grammar doesn't know."""
    rows = play.filter(F.col("event_code").isNull() | (F.col("event_code") == 0)).groupBy("event").agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "event").limit(top)


CATEGORIES = ("unknown_event", "unparsed_advance", "outs_overflow")


def findings(records: DataFrame, play: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """What the grammar and the replay stumble over: category, game_id, seq, event, detail, comment.

    ``records`` is the record stream (``read_records``); a play's comment is the record right behind it, if that is one. Overflowing
    outs come from the replayed plays, by ``play_seq`` and without comment. ``of``, if given, is a cheaper plan of the trimmed events.
    """
    along = Window.partitionBy("game_id").orderBy("seq")
    ahead = records.filter(F.col("type").isin("play", "com")).select(
        "game_id", "seq", "type", F.trim("f6").alias("event"), F.lead(F.struct("type", "seq", "f1")).over(along).alias("next")
    )
    comment = F.when((F.col("next.type") == "com") & (F.col("next.seq") == F.col("seq") + 1), F.col("next.f1"))
    plays = ahead.filter("type = 'play' AND event NOT IN ('', 'NP')").select("game_id", "seq", "event", comment.alias("comment"))
    parsed = once(plays, lambda df: parse_events(df).select("event", "event_code", unparsed_advances(F.col("event")).alias("bad")), of=of)
    found = F.filter(
        F.array(
            F.when(F.col("event_code") == 0, F.struct(F.lit("unknown_event").alias("category"), F.lit("no known event").alias("detail"))),
            F.when(F.size("bad") > 0, F.struct(F.lit("unparsed_advance").alias("category"), F.array_join("bad", ",").alias("detail"))),
        ),
        lambda x: x.isNotNull(),
    )
    told = parsed.select("game_id", "seq", "event", "comment", F.inline(found)).select("category", "game_id", "seq", "event", "detail", "comment")
    outs = F.concat(F.col("outs_before").cast("string"), F.lit(" + "), F.col("outs_on_play").cast("string"))
    beyond = play.filter("outs_before + outs_on_play > 3").select(
        F.lit("outs_overflow").alias("category"), "game_id", F.col("play_seq").alias("seq"), "event", outs.alias("detail"), F.lit(None).cast("string").alias("comment")
    )
    return told.unionByName(beyond)


def finding_counts(found: DataFrame, records: DataFrame) -> DataFrame:
    """Of each category how many, and their share of the plays in percent: one aggregation of one row."""
    live = records.filter("type = 'play' AND trim(f6) NOT IN ('', 'NP')").select(F.lit("plays").alias("category"))
    sums = found.select("category").unionByName(live).agg(*[count_if(F.col("category") == c).alias(c) for c in (*CATEGORIES, "plays")])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("n"), rate(c, "plays", 3, 100).alias("pct")) for c in CATEGORIES])))


def finding_samples(found: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """At most so many of each category, the first by game and place."""
    order = Window.partitionBy("category").orderBy("game_id", "seq", "event")
    return found.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= samples).drop("_n")
