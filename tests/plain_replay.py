"""A plain model of the replay: one game at a time, in Python. The library's column expressions are held against it."""

import re

from dugout.functions.events import CODES

_IMPLIED = re.compile(r"(POCS|SB|CS|PO)([123H])(\([^)]*\))?")
_HOME = 4
_BASE = {"1": 1, "2": 2, "3": 3, "H": _HOME}
_KINDS = ("po", "a", "e", "pb", "xi")


def implied_moves(plays: list[dict]) -> dict[int, tuple[int, bool]]:
    """Moves that a base-running play implies, by the base it starts from: the base it ends on, and if it is an out."""
    moves: dict[int, tuple[int, bool]] = {}
    for play in plays:
        for kind, base, paren in _IMPLIED.findall(play["basic"]):
            target = _BASE[base]
            start = target if kind == "PO" else target - 1
            if 1 <= start <= 3:  # nobody is stolen from or picked off at home or the plate
                moves.setdefault(start, (target, kind != "SB" and "E" not in paren))
    return moves


class Game:
    """One game's state. ``strict`` also retires runners that a fielder's mark puts out, spares runners whose out
    an error undid, and places the runners of extra innings."""

    def __init__(self, strict: bool = False):
        self.strict = strict
        self.bases: dict[int, str] = {}
        self.fielders: dict[tuple[int, int], str] = {}
        self.score = [0, 0]
        self.outs, self.inning = 0, None
        self.placed: set[str] = set()
        self.lines: dict[tuple[str, int], dict] = {}

    def line(self, player: str, position: int, side: int) -> dict:
        fresh = {"side": side, "games_started": False, "outs": 0, "dp": 0, "tp": 0, **dict.fromkeys(_KINDS, 0)}
        return self.lines.setdefault((player, position), fresh)

    def station(self, player: str, side, position, start: bool = False) -> None:
        if side is None or position is None or not 1 <= position <= 9:
            return
        self.fielders[int(side), int(position)] = player
        line = self.line(player, int(position), int(side))
        line["games_started"] |= start

    def place(self, player: str, base) -> None:
        """A runner put on a base before a half-inning's first play."""
        if base in (1, 2, 3):
            self.bases[int(base)] = player
            self.placed.add(player)

    def play(self, p: dict) -> dict:
        half = int(p["half"])
        if (p["inning"], half) != self.inning:
            self.inning, self.outs = (p["inning"], half), 0
            self.bases = {b: r for b, r in self.bases.items() if r in self.placed}
        self.placed = set()
        before = dict(self.bases)
        moves = {(0 if a["from"] == "B" else int(a["from"])): (_BASE[a["to"]], self._is_out(a)) for a in p["advances"]}
        moves = implied_moves(p["plays"]) | moves
        if self.strict:
            for base in re.findall(r"\(([123])\)", p["primary_basic"] if p["event_code"] == CODES["genericOut"] else ""):
                moves.setdefault(int(base), (int(base), True))
        if 0 in moves:
            batter = 0 if moves[0][1] else moves[0][0]
        else:
            batter = int(p["hit_value"]) or int(p["batter_reached"])
        ends = {b: (0 if moves[b][1] else moves[b][0]) if b in moves else b for b in before}
        if batter == 1:  # a batter on first forces whoever stands in the way
            for b in (1, 2, 3):
                if b not in before or b in moves:
                    break
                ends[b] = b + 1
        after: dict[int, str] = {}
        for player, end in [*((before[b], ends[b]) for b in sorted(before)), (p["batter_id"], batter)]:
            if 1 <= end <= 3:
                after[end] = player
        runs = [*ends.values(), batter].count(_HOME)
        fielding = 1 - half
        row = {
            "outs_before": self.outs, "pitcher_id": self.fielders.get((fielding, 1)), "runs_on_play": runs,
            "away_score_before": self.score[0], "home_score_before": self.score[1], "batter_dest": batter,
            **{f"base{b}_before": before.get(b) for b in (1, 2, 3)}, **{f"run{b}_dest": ends.get(b, 0) for b in (1, 2, 3)},
        }
        self.score[half] += runs
        self.outs += int(p["outs_on_play"])
        self.bases = after
        self._field(p, fielding)
        return row

    def _is_out(self, advance: dict) -> bool:
        return advance["out"] and not (self.strict and any("E" in x for x in advance["params"]))

    def _field(self, p: dict, side: int) -> None:
        for (s, position), player in self.fielders.items():
            if s == side:
                self.line(player, position, side)["outs"] += int(p["outs_on_play"])
        helped = set()
        for credit in p["credits"]:
            position, kind = credit["position"], credit["kind"]
            if player := self.fielders.get((side, position)):
                self.line(player, position, side)[kind] += 1
                if kind in ("po", "a"):
                    helped.add((player, position))
        for key in helped:
            self.lines[key]["dp"] += bool(p["double_play"])
            self.lines[key]["tp"] += bool(p["triple_play"])


def walk(rows, strict=False):
    """A game's plays and its fielding lines, from the rows of its timeline."""
    state, out = Game(strict), []
    for p in sorted(rows, key=lambda p: p["seq"]):
        if p["kind"] == "play":
            out.append({"play_seq": len(out), "event": p["event"], **state.play(p)})
        elif p["kind"] == "radj":
            if strict:
                state.place(p["player_id"], p["fielding_position"])
        else:
            state.station(p["player_id"], p["side"], p["fielding_position"], p["kind"] == "start")
    return out, [{"player_id": who, "position": at, "games": 1, **line} for (who, at), line in state.lines.items()]
