"""The event grammar as Column expressions.

An event is ``plays[.advances]``: plays joined by ``+``, each a basic with ``/modifiers``; advances joined by
``;``. Delimiters within parentheses don't count. All of it stays in Catalyst: strings are cut by regular
expressions into arrays of structs, and flags and counts are folds over those arrays.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dugout.operators.shared import written

#: The documented code of every kind of event.
CODES = {
    "unknown": 0, "noPlay": 1, "genericOut": 2, "strikeout": 3, "stolenBase": 4, "defensiveIndifference": 5,
    "caughtStealing": 6, "pickoffError": 7, "pickoff": 8, "wildPitch": 9, "passedBall": 10, "balk": 11,
    "otherAdvance": 12, "foulError": 13, "walk": 14, "intentionalWalk": 15, "hitByPitch": 16, "interference": 17,
    "error": 18, "fieldersChoice": 19, "single": 20, "double": 21, "triple": 22, "homeRun": 23,
}
#: Which kind a basic is, by the first pattern that its start matches.
BASICS = (
    ("noPlay", r"NP$"), ("stolenBase", r"SB"), ("pickoff", r"POCS"), ("caughtStealing", r"CS"), ("pickoff", r"PO"),
    ("wildPitch", r"WP"), ("passedBall", r"PB"), ("balk", r"BK"), ("defensiveIndifference", r"DI"),
    ("otherAdvance", r"OA"), ("foulError", r"FLE"), ("homeRun", r"(HR?$|HR?\d)"), ("double", r"DGR$"),
    ("single", r"S(\d|$)"), ("double", r"D(\d|$)"), ("triple", r"T(\d|$)"), ("strikeout", r"K"),
    ("intentionalWalk", r"(IW|I$)"), ("walk", r"W"), ("hitByPitch", r"HP"), ("error", r"E"), ("fieldersChoice", r"FC"),
    ("interference", r"C(?!\d)"), ("genericOut", r"\d"),
)
#: Codes of events that aren't the batter's: base running, and no play.
_NOT_BATTER = [CODES[k] for k in (
    "noPlay", "stolenBase", "defensiveIndifference", "caughtStealing", "pickoffError", "pickoff", "wildPitch",
    "passedBall", "balk", "otherAdvance", "foulError",
)]
_NO_AT_BAT = [CODES[k] for k in ("walk", "intentionalWalk", "hitByPitch", "interference", "noPlay")]
_RUNNER_OUT = [CODES["caughtStealing"], CODES["pickoff"]]
_OUTSIDE = r"(?![^(]*\))"
_FLAT = r"^[^()]*(?:\([^()]*\)[^()]*)*$"


def split_outside(text: Column, sign: str, at_most: int = -1) -> Column:
    """``text`` cut at each ``sign`` that doesn't lie within parentheses, into ``at_most`` pieces if that is given.

    Depth is the number of parentheses open so far; one that closes none is passed over, and what one that stays open
    holds goes on to the end. Where all are closed and none is nested, as nearly always, a regular expression does.
    """
    start = F.struct(F.lit(0).alias("depth"), F.array(F.lit("")).alias("pieces"))

    def step(s: Column, c: Column) -> Column:
        depth = F.when(c == "(", s["depth"] + 1).when(c == ")", F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"])
        cut = (c == sign) & (depth == 0) & (F.lit(at_most < 0) | (F.size(s["pieces"]) < at_most))
        last = F.concat(F.element_at(s["pieces"], -1), c)
        longer = F.array_append(F.slice(s["pieces"], F.lit(1), F.size(s["pieces"]) - 1), last)
        return F.struct(depth.alias("depth"), F.when(cut, F.array_append(s["pieces"], F.lit(""))).otherwise(longer).alias("pieces"))

    signs = F.regexp_extract_all(text, F.lit("(?s)(.)"), F.lit(1))
    return F.when(text.rlike(_FLAT), F.split(text, re.escape(sign) + _OUTSIDE, at_most)).otherwise(F.aggregate(signs, start, step, lambda s: s["pieces"]))


def classify(basic: Column) -> Column:
    """The code of a basic."""
    out = None
    for kind, pattern in BASICS:
        hit, code = basic.rlike("^" + pattern), F.lit(CODES[kind])
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return out.otherwise(CODES["unknown"])


def hit_value(code: Column) -> Column:
    return F.when(code.between(CODES["single"], CODES["homeRun"]), code - CODES["single"] + 1).otherwise(0)


def _plays(part: Column) -> Column:
    tokens = F.filter(F.transform(split_outside(part, "+"), lambda t: F.trim(t)), lambda t: t != "")
    pieces = lambda t: split_outside(t, "/")
    return F.transform(
        F.transform(tokens, pieces),
        lambda p: F.struct(p[0].alias("basic"), F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))).alias("modifiers"), classify(p[0]).alias("code")),
    )


def _advances(part: Column) -> Column:
    tokens = F.filter(F.transform(split_outside(part, ";"), lambda t: F.trim(t)), lambda t: t.rlike("^[B123][-X][123H]"))
    return F.transform(
        tokens,
        lambda t: F.struct(
            F.substring(t, 1, 1).alias("from"),
            F.substring(t, 3, 1).alias("to"),
            (F.substring(t, 2, 1) == "X").alias("out"),
            F.regexp_extract_all(F.substr(t, F.lit(4)), F.lit(r"\(([^)]*)\)"), F.lit(1)).alias("params"),
        ),
    )


def unparsed_advances(event: Column) -> Column:
    """What stands among an event's advances and isn't one."""
    parts = split_outside(F.translate(F.trim(F.coalesce(event, F.lit(""))), "!?#", ""), ".", 2)
    tokens = F.transform(split_outside(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), ";"), lambda t: F.trim(t))
    return F.filter(tokens, lambda t: (t != "") & ~t.rlike("^[B123][-X][123H]"))


def _count(array: str | Column, condition) -> Column:
    return F.size(F.filter(array, condition))


def parse_events(df: DataFrame, event: str = "event") -> DataFrame:
    """Add the parsed form of the event strings.

    plays (basic, modifiers, code), advances (from, to, out, params), event_code, event_name, hit_value, at_bat,
    sac_fly, sac_hit, double_play, triple_play, wild_pitch, passed_ball, outs_on_play, rbi, batter_reached and
    primary_basic. A null event is parsed as an empty one; malformed advances are left out.
    """
    clean = F.translate(F.trim(F.coalesce(F.col(event), F.lit(""))), "!?#", "")
    halves = split_outside(clean, ".", 2)
    df = df.withColumns({"plays": _plays(halves[0]), "advances": _advances(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))})
    own = F.filter("plays", lambda p: ~p["code"].isin(_NOT_BATTER))
    nothing = F.struct(F.lit("").alias("basic"), F.array().cast("array<string>").alias("modifiers"), F.lit(0).alias("code"))
    df = df.withColumn("_primary", F.coalesce(F.get(own, F.lit(0)), F.get("plays", F.lit(0)), nothing))
    code, basic = F.col("_primary.code"), F.col("_primary.basic")
    modifiers = F.flatten(F.transform("plays", lambda p: p["modifiers"]))
    has = lambda pattern: F.exists(modifiers, lambda m: m.rlike(pattern))
    any_play = lambda kind: F.exists("plays", lambda p: p["code"] == CODES[kind])
    # runs of fielders, each perhaps with the base at which it retired somebody; a bare run at the end retires the batter
    runs = F.regexp_extract_all(basic, F.lit(r"(\d+(?:\([B123]\))?)"), F.lit(1))
    bare_end = F.coalesce(~F.element_at(F.when(F.size(runs) > 0, runs), -1).endswith(")"), F.lit(False))
    is_out = code == CODES["genericOut"]
    batter_out = bare_end | F.exists(runs, lambda r: r.endswith("(B)"))
    batter = F.get(F.filter("advances", lambda a: a["from"] == "B"), F.lit(0))
    df = df.withColumns({
        "event_code": code,
        "primary_basic": basic,
        "hit_value": hit_value(code),
        "sac_fly": has("^SF"), "sac_hit": has("^SH"), "double_play": has("DP$"), "triple_play": has("TP$"),
        "wild_pitch": any_play("wildPitch"), "passed_ball": any_play("passedBall"),
        "_batter_advance": batter,
        "_runs_out": F.when(is_out, _count(runs, lambda r: r.endswith(")")) + bare_end.cast("int")).otherwise(0),
        "_by_class": F.when(is_out, ~batter_out).otherwise(code.between(14, 23)),
    })
    names = F.create_map(*[F.lit(x) for name, c in CODES.items() for x in (c, name)])
    code = F.col("event_code")
    caught = lambda p: p["code"].isin(_RUNNER_OUT) & ~F.contains(p["basic"], F.lit("E"))
    erred = lambda a: F.exists(a["params"], lambda x: F.contains(x, F.lit("E")))
    unearned = lambda x: x.isin("NR", "NORBI", "WP", "PB", "TH") | x.startswith("E")
    is_batter = ~code.isin(_NOT_BATTER)
    df = df.withColumn("batter_reached", F.coalesce(~F.col("_batter_advance.out"), F.col("_by_class")))
    struck = (code == CODES["strikeout"]) & ~F.col("batter_reached") & ~F.coalesce(F.col("_batter_advance.out"), F.lit(False))
    driven = lambda a: (a["to"] == "H") & ~a["out"] & ~F.exists(a["params"], unearned)
    homer = (F.col("hit_value") == 4) & ~F.exists("advances", lambda a: (a["from"] == "B") & (a["to"] == "H"))
    return df.withColumns({
        "event_name": names[code],
        "at_bat": is_batter & ~code.isin(_NO_AT_BAT) & ~F.col("sac_fly") & ~F.col("sac_hit"),
        "outs_on_play": F.col("_runs_out") + struck.cast("int") + _count("plays", caught) + _count("advances", lambda a: a["out"] & ~erred(a)),
        "rbi": F.when(is_batter, _count("advances", driven)).otherwise(0) + homer.cast("int"),
    }).drop("_primary", "_batter_advance", "_runs_out", "_by_class")


def once(df: DataFrame, parse: Callable[[DataFrame], DataFrame], event: str = "event", of: DataFrame | None = None) -> DataFrame:
    """``df`` with what ``parse`` adds to a frame of event strings, each distinct string parsed once: an archive repeats few strings
    in very many plays. The parsed strings are written, so that Spark knows their size when it joins them, and can split the
    partition of a frequent one. ``of`` may give the strings from a cheaper plan than ``df``; it must hold all of them."""
    own = (df if of is None else of).select(event).distinct()
    parsed = written(parse(own), "events").withColumnRenamed(event, "_string")
    return df.join(parsed, F.col(event).eqNullSafe(F.col("_string")), "left").drop("_string")


def derived_runs(event: Column) -> Column:
    """Runs by counting what the string says: advances to home, a home run's batter, and steals of home."""
    homer = F.split_part(event, F.lit("."), F.lit(1)).rlike(r"^(HR|H)([^A-Za-z]|$)") & ~F.contains(event, F.lit("B-H"))
    steals = F.regexp_count(event, F.lit("SBH")) - F.contains(event, F.lit("3-H")).cast("int")
    return F.regexp_count(event, F.lit("[B123]-H")) + homer.cast("int") + F.greatest(F.lit(0), steals)


def plate_appearance(code: Column, hit: Column) -> Column:
    """A completed turn at bat, for the daily lines."""
    return code.isin(2, 3, 14, 15, 16, 17, 18, 19) | (hit > 0)


def completes_turn(code: Column) -> Column:
    """The studies' rule for a batter faced; it differs from ``plate_appearance`` on codes 0 and 1."""
    return (code < 4) | (code > 13)
