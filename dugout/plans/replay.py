"""Replay: the state of every game, play by play.

The event strings are parsed by Catalyst beforehand, fielding credits and the runners' moves included. What is left is a
fold over one game's rows in order (some eighty of them): who stands on which base, who plays where, outs and score. It is an
aggregate over an array of structs, so a game is shuffled once, and no row leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dugout.functions.columns import balls_and_strikes
from dugout.functions.events import CODES, once, parse_events
from dugout.functions.fielding import credits
from dugout.schemas import FIELDING_LINE, PLAY

_HOME = 4
#: A play's fields that the parser gives and the output keeps.
_PARSED = (
    "event_code", "event_name", "hit_value", "at_bat", "sac_fly", "sac_hit", "double_play", "triple_play", "wild_pitch",
    "passed_ball", "outs_on_play", "rbi",
)
_KINDS = ("po", "a", "e", "pb", "xi")
_TALLIES = f"array<struct<position:int,{','.join(f'{c}:int' for c in (*_KINDS, 'dp', 'tp'))}>>"


def tallies() -> Column:
    """A play's credits by position: how many of each kind, and if it is one of a double or triple play."""
    count = lambda kind, at: F.size(F.filter("credits", lambda c: (c["kind"] == kind) & (c["position"] == at)))
    helped = lambda at: F.exists("credits", lambda c: c["kind"].isin("po", "a") & (c["position"] == at))
    both = lambda at, flag: F.coalesce((helped(at) & F.col(flag)).cast("int"), F.lit(0))
    positions = F.array_distinct(F.filter(F.transform("credits", lambda c: c["position"]), lambda p: p.between(1, 9)))
    of = lambda at: F.struct(at.alias("position"), *[count(k, at).alias(k) for k in _KINDS], both(at, "double_play").alias("dp"), both(at, "triple_play").alias("tp"))
    return F.transform(positions, of).cast(_TALLIES)


def _number(base: Column) -> Column:
    return F.when(base == "H", _HOME).otherwise(base.try_cast("int"))


def implied_moves(plays: str = "plays") -> Column:
    """Moves that base-running plays imply: the base each starts from, and where it ends (0 for an out), in order."""
    found = F.flatten(F.transform(plays, lambda p: F.regexp_extract_all(p["basic"], F.lit(r"((?:POCS|SB|CS|PO)[123H](?:\([^)]*\))?)"), F.lit(1))))

    def move(mark: Column) -> Column:
        kind, base = F.regexp_extract(mark, "^(POCS|SB|CS|PO)", 1), _number(F.regexp_extract(mark, "^(?:POCS|SB|CS|PO)(.)", 1))
        out = (kind != "SB") & ~F.contains(mark, F.lit("E"))
        return F.struct(F.when(kind == "PO", base).otherwise(base - 1).alias("start"), F.when(out, 0).otherwise(base).alias("end"))

    return F.filter(F.transform(found, move), lambda m: m["start"].between(1, 3))  # nobody is stolen from or picked off at home


def moves(strict: bool) -> dict[str, Column]:
    """Where the batter ends (``to0``), and runners from each base (``to1`` to ``to3``): 0 for out or none, 4 for home; null if
    the event doesn't say. An advance given outright counts, the last of one base, before an implied one, the first."""

    def given(base: str) -> Column:
        own = F.filter("advances", lambda a: a["from"] == base)
        last = F.get(own, F.size(own) - 1)
        out = last["out"] & ~F.exists(last["params"], lambda x: F.contains(x, F.lit("E"))) if strict else last["out"]
        return F.when(out, 0).otherwise(_number(last["to"]))

    def runner(base: int) -> Column:
        steps = [given(str(base)), F.get(F.filter("_implied", lambda m: m["start"] == base), F.lit(0))["end"]]
        if strict:
            marked = (F.col("event_code") == CODES["genericOut"]) & F.contains("primary_basic", F.lit(f"({base})"))
            steps.append(F.when(marked, 0))
        return F.coalesce(*steps)

    by_class = F.when(F.col("hit_value") > 0, F.col("hit_value")).otherwise(F.col("batter_reached").cast("int"))
    ends = {"to0": F.coalesce(given("B"), by_class)} | {f"to{b}": runner(b) for b in (1, 2, 3)}
    return {name: end.cast("int") for name, end in ends.items()}


def timeline(starts: DataFrame, subs: DataFrame, plays: DataFrame, adjustments: DataFrame | None = None, of: DataFrame | None = None) -> DataFrame:
    """All that moves a game's state, as one frame: the kinds start, sub, radj and play, in the order of ``seq``.

    Plays that are blank or ``NP`` are left out. Parsing happens here, before the shuffle by game, once for each distinct event:
    ``moves`` and ``strict_moves`` hold where everybody ends. ``of``, if given, is a cheaper plan of the column ``event``.
    """

    def parse(df: DataFrame) -> DataFrame:
        df = parse_events(df).withColumn("credits", credits()).withColumn("_implied", implied_moves())
        df = df.withColumn("tallies", tallies())
        ends = {name: F.struct(*[c.alias(n) for n, c in moves(strict).items()]) for name, strict in (("moves", False), ("strict_moves", True))}
        return df.withColumns(ends).select("event", "plays", "advances", "primary_basic", "batter_reached", "credits", "tallies", *ends, *_PARSED)

    named = lambda df: df.filter(~F.trim(F.coalesce("event", F.lit(""))).isin("", "NP")).withColumn("event", F.trim("event"))
    parsed = once(named(plays), parse, of=None if of is None else named(of)).select("*", balls_and_strikes("count").alias("_c")).select(
        "game_id", "seq", F.lit("play").alias("kind"), "inning", "half", "batter_id", "_c.balls", "_c.strikes",
        F.col("pitches").alias("pitch_seq"), "event", "plays", "advances", "primary_basic", "batter_reached", "credits", "tallies", "moves", "strict_moves", *_PARSED,
    )
    who = lambda df, kind, seq: df.select("game_id", seq.alias("seq"), F.lit(kind).alias("kind"), "player_id", "side", "fielding_position")
    out = parsed.unionByName(who(starts, "start", F.lit(-1)), allowMissingColumns=True)
    out = out.unionByName(who(subs, "sub", F.col("seq")), allowMissingColumns=True)
    if adjustments is not None:
        placed = adjustments.filter("adj_type = 'radj'").select(
            "game_id", "seq", F.lit("radj").alias("kind"), F.col("field1").alias("player_id"),
            F.expr("try_cast(field2 as smallint)").alias("fielding_position"),
        )
        out = out.unionByName(placed, allowMissingColumns=True)
    return out


#: What the fold tells of a play, and what it carries on. Places in arrays count from 0.
_SEEN = (
    "struct<outs_before:int,pitcher_id:string,runs_on_play:int,away_score_before:int,home_score_before:int,base1_before:string,base2_before:string,"
    "base3_before:string,batter_dest:int,run1_dest:int,run2_dest:int,run3_dest:int,fielders:array<string>>"
)
_STATE = f"struct<inning:int,half:int,outs:int,bases:array<string>,placed:array<boolean>,score:array<int>,fielders:array<string>,seen:array<{_SEEN}>>"


def _let(name: str, value: str, use: str) -> str:
    """``use`` with the value computed once, under a name."""
    return f"get(transform(array({value}), {name} -> {use}), 0)"


def _state(**fields: str) -> str:
    """A state: what isn't given stays as it is in ``s``. Its types are those of _STATE, so that no cast copies it."""
    names = ("inning", "half", "outs", "bases", "placed", "score", "fielders", "seen")
    return f"struct({', '.join(fields.get(n, f's.{n}') + f' AS {n}' for n in names)})"


_NOTHING_SEEN = f"array_append(s.seen, CAST(NULL AS {_SEEN}))"


def _put(array: str, at: str, value: str) -> str:
    """The array with the value at that place; unchanged at null."""
    return f"transform(s.{array}, (x, i) -> CASE WHEN i = {at} THEN {value} ELSE x END)"


def _played() -> str:
    """The state behind a play ``p``."""
    # where the runner from each base ends; a batter on first forces whoever stands in the way
    ends, forced = [], "p.to0 = 1"
    for b in (1, 2, 3):
        forced += f" AND was.b{b} IS NOT NULL AND p.to{b} IS NULL"
        ends.append(f"CASE WHEN was.b{b} IS NULL THEN 0 WHEN p.to{b} IS NOT NULL THEN p.to{b} WHEN {forced} THEN {b + 1} ELSE {b} END AS r{b}")
    # where two end on one base the one from further on stays, and the batter before all
    on = [f"CASE WHEN p.to0 = {b} THEN p.batter_id " + " ".join(f"WHEN to.r{k} = {b} THEN was.b{k}" for k in (3, 2, 1)) + " END" for b in (1, 2, 3)]
    runs = " + ".join(f"IF({x} = {_HOME}, 1, 0)" for x in ("p.to0", "to.r1", "to.r2", "to.r3"))
    field = "slice(s.fielders, IF(p.half = 1, 1, 10), 9)"
    values = ("was.outs", f"get({field}, 0)", runs, "s.score[0]", "s.score[1]", "was.b1", "was.b2", "was.b3", "p.to0", "to.r1", "to.r2", "to.r3", field)
    seen = "struct(" + ", ".join(f"{v} AS {n.partition(':')[0]}" for v, n in zip(values, _SEEN[7:-1].split(","), strict=True)) + ")"
    after = _state(
        inning="CAST(p.inning AS INT)", half="CAST(p.half AS INT)", outs="was.outs + CAST(p.outs_on_play AS INT)", bases=f"array({', '.join(on)})", placed="array(false, false, false)",
        score=f"transform(s.score, (x, i) -> x + IF(i = IF(p.half = 1, 1, 0), {runs}, 0))", seen=f"array_append(s.seen, {seen})",
    )
    # a new half-inning begins with no outs, and with nobody on base but runners placed there
    bases = [f"IF(p.inning <=> s.inning AND p.half <=> s.half OR s.placed[{b - 1}], s.bases[{b - 1}], NULL) AS b{b}" for b in (1, 2, 3)]
    was = f"struct(IF(p.inning <=> s.inning AND p.half <=> s.half, s.outs, 0) AS outs, {', '.join(bases)})"
    return _let("was", was, _let("to", f"struct({', '.join(ends)})", after))


def _fold(strict: bool) -> str:
    placed = _state(bases=_put("bases", "p.fielding_position - 1", "p.player_id"), placed=_put("placed", "p.fielding_position - 1", "true"), seen=_NOTHING_SEEN)
    stationed = _state(fielders=_put("fielders", "p.slot", "p.player_id"), seen=_NOTHING_SEEN)
    step = f"CASE WHEN p.kind = 'play' THEN {_played()} WHEN p.kind = 'radj' THEN {placed if strict else _state(seen=_NOTHING_SEEN)} ELSE {stationed} END"
    nobody = "array_repeat(CAST(NULL AS STRING), {})"
    start = f"CAST(struct(NULL, NULL, 0, {nobody.format(3)}, array(false, false, false), array(0, 0), {nobody.format(18)}, array()) AS {_STATE})"
    return f"aggregate(rows, {start}, (s, p) -> {step}, s -> s.seen)"


def _rank() -> Column:
    """The place of a kind among rows of one seq."""
    return F.array_position(F.array(*map(F.lit, ("start", "radj", "sub", "play"))), F.col("kind"))


def _slot() -> Column:
    """Where somebody is stationed: places of side 0 from 0, of side 1 from 9; null for whoever doesn't field."""
    return F.expr("CAST(CASE WHEN kind IN ('start', 'sub') AND side IN (0, 1) AND fielding_position BETWEEN 1 AND 9 AND player_id IS NOT NULL THEN side * 9 + fielding_position - 1 END AS INT)")


def replayed(events: DataFrame, strict: bool = False) -> DataFrame:
    """A ``timeline`` with the state before each play, and the fielders in the field: ``plays_of`` and ``lines_of`` read it.

    ``strict`` also retires runners that a fielder's mark puts out, spares runners whose out an error undid, and places the
    runners of extra innings. Rows of one ``seq`` go by kind (starts, placed runners, substitutions, plays), position and
    player. Someone without a side or without a position from 1 to 9 doesn't field; a null player isn't stationed.
    """
    ends = F.col("strict_moves" if strict else "moves")
    rows = events.select("*", _rank().alias("rank"), _slot().alias("slot"), *[ends[f"to{b}"].alias(f"to{b}") for b in range(4)])
    rows = rows.drop("plays", "advances", "primary_basic", "batter_reached", "moves", "strict_moves", "tallies")  # of which the parser has made use
    order = ["seq", "rank", "fielding_position", "player_id"]
    games = rows.groupBy("game_id").agg(F.sort_array(F.collect_list(F.struct(*order, *[c for c in rows.columns if c not in ("game_id", *order)]))).alias("rows"))
    both = games.select("game_id", F.expr(f"inline(zip_with(rows, {_fold(strict)}, (row, seen) -> struct(row, seen)))").alias("row", "seen"))
    return both.select("game_id", "row.*", "seen.*")


def outs_of(events: DataFrame) -> DataFrame:
    """The plays of a ``timeline`` with ``play_seq`` and ``outs_before`` as ``plays_of`` has them, and nothing else of the state: outs
    are a running sum that starts anew with each half-inning, so this is one sort by game without a fold."""
    order = Window.partitionBy("game_id").orderBy("seq", "player_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("inning").eqNullSafe(F.lag("inning").over(order)) & F.col("half").eqNullSafe(F.lag("half").over(order))
    plays = events.filter("kind = 'play'").select(
        "game_id", "seq", "player_id", "event", F.col("outs_on_play").cast("int").alias("outs_on_play"), (F.row_number().over(order) - 1).alias("play_seq"),
        F.coalesce(F.sum("outs_on_play").over(before), F.lit(0)).alias("_so_far"), same.alias("_same"),
    )
    began = F.coalesce(F.last(F.when(~F.col("_same"), F.col("_so_far")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return plays.select("game_id", "play_seq", "event", (F.col("_so_far") - began).cast("int").alias("outs_before"), "outs_on_play")


def plays_of(rows: DataFrame) -> DataFrame:
    """The table ``play``: the plays of each game numbered from 0."""
    plays = rows.filter("kind = 'play'")
    number = F.row_number().over(Window.partitionBy("game_id").orderBy("seq", "player_id")) - 1
    return plays.withColumn("play_seq", number).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in PLAY])


def lines_of(rows: DataFrame) -> DataFrame:
    """Fielding lines: who was stationed where, the outs they stood through, and the credits that fell to their position."""
    count = lambda kind, at: F.size(F.filter("credits", lambda c: (c["kind"] == kind) & (c["position"] == at)))

    def stood(player: Column, i: Column) -> Column:
        at = i + 1
        helped = F.exists("credits", lambda c: c["kind"].isin("po", "a") & (c["position"] == at))
        both = lambda flag: (helped & F.col(flag)).cast("int")
        return F.struct(
            player.alias("player_id"), at.alias("position"), (1 - F.col("half")).cast("int").alias("side"), F.lit(False).alias("started"), F.col("outs_on_play").alias("outs"),
            *[count(k, at).alias(k) for k in _KINDS], both("double_play").alias("dp"), both("triple_play").alias("tp"),
        )

    nothing = [F.lit(0).alias(c) for c in ("outs", *_KINDS, "dp", "tp")]
    came = F.struct(
        F.col("player_id").alias("player_id"), F.col("fielding_position").cast("int").alias("position"), F.col("side").cast("int").alias("side"), (F.col("kind") == "start").alias("started"), *nothing
    )
    entries = F.when(F.col("kind") == "play", F.filter(F.transform("fielders", stood), lambda e: e["player_id"].isNotNull())).when(F.col("slot").isNotNull(), F.array(came))
    lines = rows.select("game_id", "seq", "rank", F.inline(entries)).groupBy("game_id", "player_id", "position").agg(
        F.min_by("side", F.struct("seq", "rank")).alias("side"), F.lit(1).alias("games"), F.bool_or("started").alias("games_started"),
        *[F.sum(c).alias(c) for c in ("outs", *_KINDS, "dp", "tp")],
    )
    return lines.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in FIELDING_LINE])


def lines_from(events: DataFrame) -> DataFrame:
    """The fielding lines of a ``timeline`` as ``lines_of`` has them, without the fold: of who stands where, a play needs but those whose
    position it credits, and outs are differences of the running sum of a side's outs."""
    whole = Window.partitionBy("game_id")
    order = ["seq", "rank", "fielding_position", "player_id"]
    earlier = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    play = F.col("kind") == "play"
    field = F.when(F.col("half") == 1, 0).otherwise(1)  # the side in the field, as the fold has it
    outs = [F.coalesce(F.when(play & (field == side), F.col("outs_on_play")), F.lit(0)).cast("long") for side in (0, 1)]
    rows = events.select(
        "game_id", "seq", _rank().alias("rank"), "fielding_position", "player_id", "side", (F.col("kind") == "start").alias("started"), "tallies",
        _slot().alias("slot"), F.when(play, field).alias("field"), *[c.alias(f"_out{side}") for side, c in enumerate(outs)],
    )
    for side in (0, 1):
        rows = rows.withColumns({f"_so_far{side}": F.coalesce(F.sum(f"_out{side}").over(earlier), F.lit(0)), f"_all{side}": F.sum(f"_out{side}").over(whole)})
    rows = rows.filter(F.col("slot").isNotNull() | (F.size("tallies") > 0))
    of_side = lambda name, slot: F.when(slot < 9, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))
    none = F.array(F.struct(F.lit(None).cast("int").alias("position"), *[F.lit(0).alias(c) for c in (*_KINDS, "dp", "tp")])).cast(_TALLIES)
    rows = rows.select("*", F.inline(F.when(F.col("slot").isNotNull(), none).otherwise(F.col("tallies")))).drop("tallies")
    rows = rows.withColumn("at", F.coalesce("slot", F.col("field") * 9 + F.col("position") - 1))
    rows = rows.select("game_id", *order, "side", "started", "slot", "at", *_KINDS, "dp", "tp", of_side("_so_far", F.col("at")).alias("_so_far"), of_side("_all", F.col("at")).alias("_all"))
    there = Window.partitionBy("game_id", "at").orderBy(*order)
    # who stands there, since when, and the outs until the next row of that place
    rows = rows.select(
        "game_id", "seq", "rank", "side", "started", "slot", (F.col("at") % 9 + 1).alias("position"), *_KINDS, "dp", "tp",
        F.last(F.when(F.col("slot").isNotNull(), F.col("player_id")), ignorenulls=True).over(there.rowsBetween(Window.unboundedPreceding, 0)).alias("player_id"),
        (F.coalesce(F.lead("_so_far").over(there), F.col("_all")) - F.col("_so_far")).alias("outs"),
    ).filter("player_id IS NOT NULL")
    came = F.when(F.col("slot").isNotNull(), F.struct("seq", "rank", "side"))
    lines = rows.groupBy("game_id", "player_id", "position").agg(
        F.min(came)["side"].alias("side"), F.lit(1).alias("games"), F.coalesce(F.bool_or(F.col("started") & F.col("slot").isNotNull()), F.lit(False)).alias("games_started"),
        *[F.sum(c).alias(c) for c in ("outs", *_KINDS, "dp", "tp")],
    )
    return lines.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in FIELDING_LINE])


def replay(events: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """The tables ``play`` and the fielding lines (game_id, player_id, position, side and sums), from a ``timeline``.

    Each is a plan of its own; whoever wants both writes ``replayed`` once. By default runners move as the compatible
    rules say; see ``replayed`` for ``strict``.
    """
    rows = replayed(events, strict)
    return plays_of(rows), lines_of(rows)
