"""How an expression plan runs on Spark: which phase computes a column, and which columns move between phases.

Phases alternate: even ones have a code's rows together, odd ones a date's.  Between two of them rows are
exchanged, with only the columns that later phases read.  Windows over a code need an even phase,
ranks an odd one.  Scalar parts may be computed in any, so they are put where the fewest columns
move.  Other functions of a date are one row a date (or date and industry): in odd phases windows, in even
ones sums that are joined back by broadcast, which spares two exchanges of the panel.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.plans import expr
from tidewell.plans.expr import CODE, DATE, GROUP, WINDOWS, Node, Plan, render

RANKS = ("cs_rank", "group_rank")
#: What reading the panel once more for sums by date costs, in columns of an exchange.
AGAIN = 8
#: A phase with more columns than this has more tasks, so that a task's rows still fit its memory.
NARROW = 16
_OVER = re.compile(r"(\w+\([^()]*\)) over \(partition by (date(?:, industry)?)\)")


def _kind(n: Node) -> str:
    if n[0] != "call" or n[1] not in WINDOWS:
        return "scalar"
    return "code" if n[1].startswith(("ts_", "block_")) else "rank" if n[1] in RANKS else "date"


def _columns(n: Node) -> set[str]:
    if n[0] == "col":
        return {n[1]}
    out = set().union(*map(_columns, n[2])) if n[0] == "call" else set()
    return out | {GROUP} if n[0] == "call" and n[1].startswith("group_") else out


class Graph:
    """All columns of a chain of plans, each with its expression over other columns."""

    def __init__(self, plans: Sequence[Plan], base: Iterable[str]):
        self.base = set(base)
        self.nodes: dict[str, Node] = {}
        self.early: dict[str, int] = {}  # the first phase that can have a column
        self.known: dict[Node, str] = {}
        self.final: dict[str, str] = {}
        names: dict[str, str] = {}
        for k, p in enumerate(plans):
            for stage in p.stages:
                names |= {f"{c}": self.put(self.split(self.renamed(n, names)), f"_{k}{c}") for c, n in stage.items()}
            made = {}
            for c, n in p.final.items():
                n = self.renamed(n, names)
                if n != ("col", c):
                    n = n if n[0] == "col" and n[1] in self.nodes and self.nodes[n[1]][1] == "ts_sum" else ("call", "double", (n,))
                made[c] = n[1] if n[0] == "col" else self.put(self.split(n), f"_f_{k}_{c}")
            names = {**{c: v for c, v in names.items() if not c.startswith("_w")}, **made}
        self.final, self.names = made, names
        self.trim()

    def renamed(self, n: Node, names: dict[str, str]) -> Node:
        if n[0] == "col":
            return ("col", names.get(n[1], n[1]))
        return ("call", n[1], tuple(self.renamed(x, names) for x in n[2])) if n[0] == "call" else n

    def first(self, n: Node) -> int:
        """The first phase that has what n reads."""
        return max((self.early.get(c, 0) for c in _columns(n)), default=0)

    def put(self, n: Node, name: str) -> str:
        if n[0] == "col":
            return n[1]
        if n not in self.known:
            while name in self.nodes or name in self.base:
                name += "_"
            k = self.first(n)
            parity = {"code": 0, "rank": 1}.get(_kind(n))
            self.known[n], self.nodes[name], self.early[name] = name, n, k if parity is None or k % 2 == parity else k + 1
        return self.known[n]

    def split(self, n: Node) -> Node:
        """n with columns in place of what an earlier phase can have, of a window's arguments and of what is made from lists."""
        if n[0] != "call":
            return n
        whole, cut = self.first(n), _kind(n) != "scalar"
        args = []
        for x in n[2]:
            if x[0] == "call":
                small = self.split(x)
                x = ("col", self.put(small, f"_a{len(self.nodes)}")) if cut or x[1].startswith("list_") or self.first(x) < whole and _columns(x) else small
            args.append(x)
        return ("call", n[1], tuple(args))

    def trim(self, keep: Iterable[str] = ()) -> None:
        """Only what the results need, in an order in which it can be computed."""
        out, todo = set(), [*self.final.values(), *keep]
        while todo:
            c = todo.pop()
            if c in self.nodes and c not in out:
                out.add(c)
                todo += _columns(self.nodes[c])
        self.used = [c for c in self.nodes if c in out]

    def weight(self, c: str) -> int:
        n = self.nodes.get(c)
        return int(n[2][1][1]) if n and n[1] in ("ts_list", "ts_rows") else 1

    def phases(self, keep: Sequence[str]) -> dict[str, int]:
        """The phase of each column, so that few columns move."""
        self.trim(keep)
        top = max((self.early[c] for c in self.used), default=0)
        tries = [self.placed(keep, end, late) for end in range(top, top + 1 + (top % 2 == 0)) for late in (False, True)]
        return min(tries, key=lambda x: x[0])[1]

    def placed(self, keep: Sequence[str], end: int, late: bool) -> tuple[float, dict[str, int]]:
        users: dict[str, list[str]] = {}
        reads = {c: _columns(self.nodes[c]) for c in self.used}
        for c, r in reads.items():
            for x in r:
                users.setdefault(x, []).append(c)
        kept = {*self.final.values(), *keep}
        parity = {c: {"code": 0, "rank": 1}.get(_kind(self.nodes[c])) for c in self.used}
        sums = [c for c in self.used if _kind(self.nodes[c]) == "date"]
        at = dict(self.early)

        def options(c: str) -> list[int]:
            low = max((at[x] for x in reads[c] if x in reads), default=0)
            high = min((at[x] for x in users.get(c, ())), default=end)
            return [k for k in range(low, high + 1) if parity[c] is None or k % 2 == parity[c]]

        def moved(c: str) -> float:
            last = max([at[x] for x in users.get(c, ())] + [end] * (c in kept), default=0)
            return self.weight(c) * max(0, last - at.get(c, 0))

        def levels() -> int:
            depth: dict[str, int] = {}
            for c in self.used:
                depth[c] = max((depth[x] for x in reads[c] if x in depth and at[x] == at[c]), default=0) + (c in sums_)
            return len({(at[c], depth[c]) for c in sums if at[c] % 2 == 0})

        sums_ = set(sums)
        if late:
            for c in reversed(self.used):
                at[c] = max(options(c))
        for _ in range(4):
            before = dict(at)
            for c in reversed(self.used) if late else self.used:
                near = [c, *reads[c]]
                cost = {}
                for k in options(c):
                    at[c] = k
                    cost[k] = sum(map(moved, near)) + (AGAIN * levels() if c in sums_ else 0)
                at[c] = min(cost, key=lambda k: (cost[k], k))
            if at == before:
                break
        at = {c: at[c] for c in self.used}
        return sum(map(moved, {*self.used, *(x for r in reads.values() for x in r), *kept})) + 2.0 * end + AGAIN * levels(), at


def _joined(panel: DataFrame, nodes: dict[str, Node]) -> DataFrame:
    """panel with functions of a date, computed from one row a date (and industry)."""
    parts: dict[str, dict[str, str]] = {}
    text = {}
    for c, n in nodes.items():

        def taken(m: re.Match) -> str:
            own = parts.setdefault(m[2], {})
            return own.setdefault(m[1], f"_s{len(parts)}_{len(own)}_{c}")

        text[c] = _OVER.sub(taken, render(n, "spark"))
    for by, calls in parts.items():
        keys = by.split(", ")
        sums = panel.groupBy(*[F.col(k).alias(f"_by_{k}") for k in keys]).agg(*[F.expr(x).alias(name) for x, name in calls.items()])
        on = F.col(keys[0]).eqNullSafe(F.col(f"_by_{keys[0]}"))
        for k in keys[1:]:
            on = on & F.col(k).eqNullSafe(F.col(f"_by_{k}"))
        panel = panel.join(F.broadcast(sums), on, "left").drop(*[f"_by_{k}" for k in keys])
    return panel.select("*", *[F.expr(t).alias(c) for c, t in text.items()]).drop(*[x for calls in parts.values() for x in calls.values()])


def run(plans: Sequence[Plan], panel: DataFrame, keep: Sequence[str]) -> tuple[DataFrame, dict[str, str], dict[str, str]]:
    """panel with the last plan's results, the columns of keep, and those of the results; keep may name columns of any plan."""
    graph = Graph(plans, panel.columns)
    kept = {c: graph.names.get(c, c) for c in keep}
    keep = [*kept.values()]
    at = graph.phases([*keep, CODE, DATE])
    have, end = set(panel.columns), max(at.values(), default=0)
    for phase in range(end + 1):
        todo = {c: graph.nodes[c] for c in graph.used if at[c] == phase}
        needed = {CODE, DATE, *keep, *graph.final.values()}
        later = needed.union(*[_columns(graph.nodes[c]) for c in graph.used if at[c] >= phase])
        if phase:
            panel = panel.select(*[c for c in panel.columns if c in later])
            parts = int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions")) * min(4, 1 + (len(panel.columns) + len(todo)) // NARROW)
            panel = panel.repartition(parts, DATE if phase % 2 else CODE)
            have = set(panel.columns)
        while todo:
            ready = {c: n for c, n in todo.items() if _columns(n) <= have}
            scalars = {c: n for c, n in ready.items() if _kind(n) == "scalar"}
            if scalars:
                panel = panel.select("*", *[F.expr(render(n, "spark")).alias(c) for c, n in scalars.items()])
                ready = scalars
            else:
                sums = {c: n for c, n in ready.items() if _kind(n) == "date" and phase % 2 == 0}
                if sums and len(sums) == len(ready):
                    panel = _joined(panel, sums)
                else:  # sums come last, when all windows beside them are there
                    ready = {c: n for c, n in ready.items() if c not in sums}
                    ranks = [c for c, n in ready.items() if n[1] == "cs_rank"]
                    ranks = ranks if len(ranks) >= expr.MANY_RANKS else []
                    read = later.union(*map(_columns, todo.values())) if ranks else have
                    panel = panel.select(*[c for c in panel.columns if c in read], *[F.expr(f"cast({render(n[2][0], 'spark')} as double)" if c in ranks else render(n, "spark")).alias(c) for c, n in ready.items()])
                    if ranks:
                        panel = expr._ranked(panel, ranks)
                        if any(_kind(n) != "scalar" for c, n in todo.items() if c not in ready):  # Spark doesn't see that rows still lie by date, and would move them with all that is made from ranks
                            panel = panel.repartition(parts, DATE)
            have = set(panel.columns)
            todo = {c: n for c, n in todo.items() if c not in ready}
    return panel, kept, graph.final
