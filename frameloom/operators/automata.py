"""Weighted automata as objects: epsilon removal, determinisation, minimisation, n-best, lattices, decoding.

A graph is the set of edges of one value of the key columns (an utterance's lattice, a lexicon): (src, dst, isym, osym, cost), with
finals as edges of dst -1 whose cost is the final cost; the start is state 0. Each graph has a bounded size and is worked on as
a whole in one task, while any number of graphs are worked on at once. For one graph of unbounded size see graphs.py, whose operators are
rounds of joins. Symbol 0 is empty; costs are negative logs, added along a path; by `log`, parallel paths add their probabilities,
else the least cost counts.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict

from pyspark.sql import DataFrame

from .batch import per_group

EDGE = "src long, dst long, isym long, osym long, cost double"
FINAL = -1
Edge = tuple[int, int, int, int, float]


def log_add(a: float, b: float) -> float:
    if a > b:
        a, b = b, a
    return a if b == math.inf else a - math.log1p(math.exp(a - b))


def _plus(log: bool):
    return log_add if log else min


def _edges(rows: list[dict]) -> tuple[list[Edge], dict[int, float]]:
    edges = [(int(r["src"]), int(r["dst"]), int(r["isym"]), int(r["osym"]), float(r["cost"])) for r in rows]
    finals: dict[int, float] = {}
    for e in edges:
        if e[1] == FINAL:
            finals[e[0]] = min(finals.get(e[0], math.inf), e[4])
    return sorted(e for e in edges if e[1] != FINAL), finals


def _rows(edges: list[Edge], finals: dict[int, float]) -> list[dict]:
    names = ("src", "dst", "isym", "osym", "cost")
    return [dict(zip(names, e, strict=True)) for e in [*edges, *((s, FINAL, 0, 0, c) for s, c in sorted(finals.items()))]]


def _out(edges: list[Edge]) -> dict[int, list[Edge]]:
    out: dict[int, list[Edge]] = defaultdict(list)
    for e in edges:
        out[e[0]].append(e)
    return out


def _distances(out: dict[int, list[Edge]], start: int, plus, tolerance: float = 1e-9) -> dict[int, float]:
    """Sum of costs of all paths from start to each state by `plus`, by relaxation with residuals, so that loops settle too."""
    total, left = {start: 0.0}, {start: 0.0}
    queue, queued = [start], {start}
    at = 0
    while at < len(queue):
        s = queue[at]
        at += 1
        queued.discard(s)
        r = left.pop(s, math.inf)
        for _, d, _, _, c in out.get(s, ()):
            new = plus(total.get(d, math.inf), r + c)
            if total.get(d, math.inf) - new > tolerance:
                left[d] = plus(left.get(d, math.inf), r + c)
                total[d] = new
                if d not in queued:
                    queue.append(d)
                    queued.add(d)
    return total


def remove_epsilon(edges: list[Edge], finals: dict[int, float], log: bool = False) -> tuple[list[Edge], dict[int, float]]:
    """Edges without symbols on either side are replaced by what can be done after them."""
    plus = _plus(log)
    silent = _out([e for e in edges if not e[2] and not e[3]])
    loud = _out([e for e in edges if e[2] or e[3]])
    best: dict[tuple, float] = {}
    ends: dict[int, float] = {}
    for s in sorted({0, *(e[0] for e in edges), *(e[1] for e in edges), *finals}):
        for t, c in _distances(silent, s, plus).items():
            if t in finals:
                ends[s] = plus(ends.get(s, math.inf), c + finals[t])
            for _, d, i, o, w in loud.get(t, ()):
                best[s, d, i, o] = plus(best.get((s, d, i, o), math.inf), c + w)
    return purge([(*k, c) for k, c in sorted(best.items())], ends)


def purge(edges: list[Edge], finals: dict[int, float], start: int = 0) -> tuple[list[Edge], dict[int, float]]:
    """Only what lies on a path from the start to a final state."""

    def reach(first: list[int], steps: dict[int, list[int]]) -> set[int]:
        seen, todo = set(first), list(first)
        while todo:
            for d in steps.get(todo.pop(), ()):
                if d not in seen:
                    seen.add(d)
                    todo.append(d)
        return seen

    ahead, back = defaultdict(list), defaultdict(list)
    for e in edges:
        ahead[e[0]].append(e[1])
        back[e[1]].append(e[0])
    good = reach([start], ahead) & reach(list(finals), back)
    return [e for e in edges if e[0] in good and e[1] in good], {s: c for s, c in finals.items() if s in good}


def determinize(edges: list[Edge], finals: dict[int, float], log: bool = False) -> tuple[list[Edge], dict[int, float]]:
    """Weighted subset construction with residual costs; a transducer's pairs of symbols count as one symbol. Empty edges are
    removed first. Graphs without the twins property have no deterministic equal: the construction would not end."""
    plus = _plus(log)
    edges, finals = remove_epsilon(edges, finals, log)
    out = _out(edges)
    first = ((0, 0.0),)
    number, todo, made, ends = {first: 0}, [first], [], {}
    while todo:
        subset = todo.pop()
        s = number[subset]
        by: dict[tuple[int, int], dict[int, float]] = defaultdict(dict)
        for state, rest in subset:
            if state in finals:
                ends[s] = plus(ends.get(s, math.inf), rest + finals[state])
            for _, d, i, o, c in out.get(state, ()):
                by[i, o][d] = plus(by[i, o].get(d, math.inf), rest + c)
        for (i, o), to in sorted(by.items()):
            low = math.inf
            for c in to.values():
                low = plus(low, c)
            target = tuple(sorted((d, round(c - low, 9) + 0.0) for d, c in to.items()))
            if target not in number:
                number[target] = len(number)
                todo.append(target)
            made.append((s, number[target], i, o, low))
    return made, ends


def _pushed(edges: list[Edge], finals: dict[int, float], log: bool) -> tuple[list[Edge], dict[int, float], float]:
    back = _out([(e[1], e[0], e[2], e[3], e[4]) for e in edges] + [(-2, s, 0, 0, c) for s, c in finals.items()])
    d = _distances(back, -2, _plus(log))
    return [(s, t, i, o, c + d[t] - d[s]) for s, t, i, o, c in edges if s in d and t in d], {s: c - d[s] for s, c in finals.items()}, d.get(0, 0.0)


def push(edges: list[Edge], finals: dict[int, float], log: bool = False) -> tuple[list[Edge], dict[int, float]]:
    """Costs moved toward the start: each edge costs what it adds to the distance to the end. The start's own distance, which all paths have in
    common, is added to the final costs, so that paths cost what they did."""
    moved, ends, common = _pushed(edges, finals, log)
    return moved, {s: c + common for s, c in ends.items()}


def minimize(edges: list[Edge], finals: dict[int, float], log: bool = False) -> tuple[list[Edge], dict[int, float]]:
    """Least deterministic graph: pushed, then states that can't be told apart are merged by refinement of the partition into
    states with equal final costs and equal edges to equal classes."""
    edges, finals, common = _pushed(*determinize(edges, finals, log), log)
    states = sorted({0, *(e[0] for e in edges), *(e[1] for e in edges)})
    out = _out(edges)
    label = {s: (round(finals[s], 6) + 0.0 if s in finals else None) for s in states}
    classes = 0
    while True:
        sign = {s: (label[s], tuple(sorted((i, o, round(c, 6) + 0.0, label[d] if classes else 0) for _, d, i, o, c in out.get(s, ())))) for s in states}
        names = {x: k for k, x in enumerate(dict.fromkeys(sign[s] for s in states))}
        label = {s: names[sign[s]] for s in states}
        if len(names) == classes:
            break
        classes = len(names)
    merged = {(label[s], label[d], i, o): c for s, d, i, o, c in edges}
    order = {label[0]: 0}
    for k in sorted(set(label.values())):
        order.setdefault(k, len(order))
    return [(order[s], order[d], i, o, c) for (s, d, i, o), c in sorted(merged.items())], {order[label[s]]: c + common for s, c in finals.items()}


def n_best(edges: list[Edge], finals: dict[int, float], n: int = 1) -> list[dict]:
    """The n cheapest paths: rank, cost and input and output symbols without empty ones. Exact lower bounds guide the search."""
    back = _out([(e[1], e[0], e[2], e[3], e[4]) for e in edges] + [(-2, s, 0, 0, c) for s, c in finals.items()])
    rest = _distances(back, -2, min)
    out, found = _out(edges), []
    heap: list[tuple] = [(rest[0], 0, 0, 0.0, None)] if 0 in rest else []
    count = 0
    pops: dict[int, int] = defaultdict(int)
    while heap and len(found) < n:
        bound, _, state, cost, trail = heapq.heappop(heap)
        if state == FINAL:
            path = []
            while trail:
                path.append(trail[0])
                trail = trail[1]
            path.reverse()
            found.append({"rank": len(found), "cost": bound, "isyms": [e[2] for e in path if e[2]], "osyms": [e[3] for e in path if e[3]]})
            continue
        pops[state] += 1
        if pops[state] > n:
            continue
        if state in finals:
            count += 1
            heapq.heappush(heap, (cost + finals[state], count, FINAL, cost, trail))
        for e in out.get(state, ()):
            if e[1] in rest:
                count += 1
                heapq.heappush(heap, (cost + e[4] + rest[e[1]], count, e[1], cost + e[4], (e, trail)))
    return found


def edge_posteriors(edges: list[Edge], finals: dict[int, float]) -> dict[int, float]:
    """Posterior probability of each edge by its place in the list: forward and backward sums over all paths."""
    ahead = _distances(_out(edges), 0, log_add)
    back = _distances(_out([(e[1], e[0], 0, 0, e[4]) for e in edges] + [(-2, s, 0, 0, c) for s, c in finals.items()]), -2, log_add)
    whole = back.get(0, math.inf)
    return {k: math.exp(whole - ahead[s] - c - back[d]) if s in ahead and d in back else 0.0 for k, (s, d, _, _, c) in enumerate(edges)}


def prune(edges: list[Edge], finals: dict[int, float], beam: float = math.inf, most: int | None = None) -> tuple[list[Edge], dict[int, float]]:
    """Edges on paths at most `beam` dearer than the best one; at most the `most` best of them, by the cost of their best path."""
    ahead = _distances(_out(edges), 0, min)
    back = _distances(_out([(e[1], e[0], 0, 0, e[4]) for e in edges] + [(-2, s, 0, 0, c) for s, c in finals.items()]), -2, min)
    if 0 not in back:
        return [], {}
    cost = {k: ahead[e[0]] + e[4] + back[e[1]] - back[0] for k, e in enumerate(edges) if e[0] in ahead and e[1] in back}
    kept = sorted((k for k, c in cost.items() if c <= beam + 1e-9), key=lambda k: (cost[k], k))[:most]
    return purge([edges[k] for k in sorted(kept)], finals)


def consensus(edges: list[Edge], finals: dict[int, float]) -> list[dict]:
    """Confusion network: edges with a word fall into slots by the longest number of words before them, and within a slot the same word's
    posteriors add up: (slot, word, p), the rest of a slot being the empty word 0."""
    edges, finals = purge(edges, finals)
    p = edge_posteriors(edges, finals)
    depth: dict[int, int] = defaultdict(int)
    for s in topological(edges):
        for e in _out(edges)[s]:
            depth[e[1]] = max(depth[e[1]], depth[s] + (1 if e[3] else 0))
    slots: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))
    for k, e in enumerate(edges):
        if e[3]:
            slots[depth[e[1]] - 1][e[3]] += p[k]
    out = []
    for slot in sorted(slots):
        words = dict(slots[slot])
        if (none := 1 - sum(words.values())) > 1e-9:
            words[0] = none
        out += [{"slot": slot, "word": w, "p": q} for w, q in sorted(words.items(), key=lambda x: (-x[1], x[0]))]
    return out


def topological(edges: list[Edge]) -> list[int]:
    """States in an order in which all edges go forward; a loop raises."""
    into: dict[int, int] = defaultdict(int)
    out = _out(edges)
    for e in edges:
        into[e[1]] += 1
    states = {e[0] for e in edges} | {e[1] for e in edges}
    ready = [s for s in sorted(states, reverse=True) if not into[s]]
    order = []
    while ready:
        s = ready.pop()
        order.append(s)
        for e in out.get(s, ()):
            into[e[1]] -= 1
            if not into[e[1]]:
                ready.append(e[1])
    if len(order) < len(states):
        raise ValueError("the graph has a loop")
    return order


def equal(a: tuple[list[Edge], dict[int, float]], b: tuple[list[Edge], dict[int, float]], tolerance: float = 1e-5) -> bool:
    """Whether two deterministic graphs are the same under a walk from their starts, costs up to a relative tolerance."""
    near = lambda x, y: abs(x - y) <= tolerance * max(1.0, abs(x), abs(y))
    outs = [_out(g[0]) for g in (a, b)]
    seen, todo = {(0, 0)}, [(0, 0)]
    while todo:
        s, t = todo.pop()
        if (s in a[1]) != (t in b[1]) or s in a[1] and not near(a[1][s], b[1][t]):
            return False
        x, y = ({(e[2], e[3]): e for e in o.get(k, ())} for o, k in zip(outs, (s, t), strict=True))
        if x.keys() != y.keys() or any(not near(x[k][4], y[k][4]) for k in x):
            return False
        for k in x:
            pair = (x[k][1], y[k][1])
            if pair not in seen:
                seen.add(pair)
                todo.append(pair)
    return True


# on tables


def _graphwise(fn, df: DataFrame, keys: list[str], schema: str = EDGE) -> DataFrame:
    return per_group(df.select(*keys, "src", "dst", "isym", "osym", "cost"), keys, lambda rows: fn(*_edges(rows)), schema)


def remove_epsilons(df: DataFrame, keys: list[str], log: bool = False) -> DataFrame:
    return _graphwise(lambda e, f: _rows(*remove_epsilon(e, f, log)), df, keys)


def determinized(df: DataFrame, keys: list[str], log: bool = False) -> DataFrame:
    return _graphwise(lambda e, f: _rows(*determinize(e, f, log)), df, keys)


def minimized(df: DataFrame, keys: list[str], log: bool = False) -> DataFrame:
    return _graphwise(lambda e, f: _rows(*minimize(e, f, log)), df, keys)


def pushed(df: DataFrame, keys: list[str], log: bool = False) -> DataFrame:
    return _graphwise(lambda e, f: _rows(*push(e, f, log)), df, keys)


def best_paths(df: DataFrame, keys: list[str], n: int = 1) -> DataFrame:
    return _graphwise(lambda e, f: n_best(e, f, n), df, keys, "rank int, cost double, isyms array<long>, osyms array<long>")


def pruned(df: DataFrame, keys: list[str], beam: float = math.inf, most: int | None = None) -> DataFrame:
    return _graphwise(lambda e, f: _rows(*prune(e, f, beam, most)), df, keys)


def posteriors(df: DataFrame, keys: list[str]) -> DataFrame:
    """Edges with their posterior `gamma`; edges off all paths have 0."""

    def run(e: list[Edge], f: dict[int, float]) -> list[dict]:
        p = edge_posteriors(e, f)
        return [r | {"gamma": p[k]} for k, r in enumerate(_rows(e, {}))]

    return _graphwise(run, df, keys, EDGE + ", gamma double")


def confusion_networks(df: DataFrame, keys: list[str]) -> DataFrame:
    return _graphwise(consensus, df, keys, "slot int, word long, p double")


def same_graphs(a: DataFrame, b: DataFrame, keys: list[str], tolerance: float = 1e-5) -> DataFrame:
    """Whether the deterministic graphs of two tables agree, per key."""
    from pyspark.sql import functions as F

    both = a.select(*keys, "src", "dst", "isym", "osym", "cost", F.lit(0).alias("side")).unionByName(b.select(*keys, "src", "dst", "isym", "osym", "cost", F.lit(1).alias("side")))

    def run(rows: list[dict]) -> list[dict]:
        return [{"same": equal(*(_edges([r for r in rows if r["side"] == k]) for k in (0, 1)), tolerance)}]

    return per_group(both, keys, run, "same boolean")


def linear_graph(words: DataFrame, keys: list[str]) -> DataFrame:
    """Chains from rows (keys, words: array of symbols): the acceptor of one sequence each, made by SQL alone."""
    from pyspark.sql import functions as F

    step = words.select(*keys, F.size("words").cast("long").alias("n"), F.posexplode("words").alias("k", "w"))
    chain = step.select(*keys, F.col("k").cast("long").alias("src"), (F.col("k") + 1).cast("long").alias("dst"), F.col("w").cast("long").alias("isym"), F.col("w").cast("long").alias("osym"), F.lit(0.0).alias("cost"))
    ends = words.select(*keys, F.greatest(F.size("words"), F.lit(0)).cast("long").alias("src"), F.lit(FINAL).cast("long").alias("dst"), F.lit(0).cast("long").alias("isym"), F.lit(0).cast("long").alias("osym"), F.lit(0.0).alias("cost"))
    return chain.unionByName(ends)


def relabel(df: DataFrame, symbols: list[int], side: str = "isym", to: int = 0) -> DataFrame:
    """Symbols (end markers, for instance) replaced on one side."""
    from pyspark.sql import functions as F

    return df.withColumn(side, F.when(F.col(side).isin(symbols), F.lit(to).cast("long")).otherwise(F.col(side)))


def self_loops(df: DataFrame, keys: list[str], symbols: list[int], cost: float = math.log(2)) -> DataFrame:
    """Every state gets a loop for each of the symbols."""
    from pyspark.sql import functions as F

    states = df.select(*keys, F.col("src").alias("s")).union(df.where(F.col("dst") != FINAL).select(*keys, "dst")).distinct()
    loops = states.select(*keys, F.col("s").alias("src"), F.col("s").alias("dst"), F.explode(F.array(*(F.lit(x).cast("long") for x in symbols))).alias("isym"))
    return df.select(*keys, "src", "dst", "isym", "osym", "cost").union(loops.select(*keys, "src", "dst", "isym", F.col("isym").alias("osym"), F.lit(cost)))


def encode(df: DataFrame) -> DataFrame:
    """Each edge's symbols and cost as one symbol, a string "input cost output"; decode takes it apart."""
    from pyspark.sql import functions as F

    return df.withColumn("code", F.when(F.col("dst") != FINAL, F.concat_ws(" ", F.col("isym"), F.col("cost"), F.col("osym")))).drop("isym", "osym").withColumn("cost", F.when(F.col("dst") == FINAL, F.col("cost")).otherwise(0.0))


def decode(df: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    part = F.split("code", " ")
    cost = F.when(F.col("code").isNull(), F.col("cost")).otherwise(part[1].cast("double"))
    return df.withColumn("isym", F.coalesce(part[0].cast("long"), F.lit(0))).withColumn("osym", F.coalesce(part[2].cast("long"), F.lit(0))).withColumn("cost", cost).drop("code")


def hidden_markov(df: DataFrame, keys: list[str], states: int = 3) -> DataFrame:
    """Each edge with an input symbol becomes a chain of `states` states with a loop and a step each, both of cost ln 2: the
    symbols of the chain's states are isym * states + place; the output and the old cost are on the first edge."""

    def run(e: list[Edge], f: dict[int, float]) -> list[dict]:
        top = max([0, *(x for s, d, *_ in e for x in (s, d)), *f]) + 1
        out: list[Edge] = []
        for s, d, i, o, c in e:
            if not i:
                out.append((s, d, i, o, c))
                continue
            chain = list(range(top, top + states))
            top += states
            half = math.log(2)
            out.append((s, chain[0], i * states, o, c))
            for k, a in enumerate(chain):
                out.append((a, a, i * states + k, 0, half))
                out.append((a, chain[k + 1] if k + 1 < states else d, i * states + k + 1 if k + 1 < states else 0, 0, half))
        return _rows(out, f)

    return _graphwise(run, df, keys)


def context_dependent(df: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Every input symbol becomes that of itself between its left and right neighbour: left * width^2 + centre * width + right, with 0
    at the ends (all symbols are under width): a state holds the last two symbols, the output stays with its symbol."""

    def run(e: list[Edge], f: dict[int, float]) -> list[dict]:
        e, f = remove_epsilon(e, f)
        out, number, made, ends = _out(e), {}, [], {}

        def state(x: tuple) -> int:
            if x not in number:
                number[x] = len(number)
                todo.append(x)
            return number[x]

        todo: list[tuple] = []
        state((0, 0, 0, 0, 0.0))
        while todo:
            x = todo.pop()
            s, left, centre, o, cost = x
            at = number[x]
            if s in f:
                if centre:
                    end = len(number)
                    number["end", x] = end
                    made.append((at, end, left * width**2 + centre * width, o, cost))
                    ends[end] = f[s]
                else:
                    ends[at] = f[s]
            for _, d, i, o2, c in out.get(s, ()):
                to = state((d, centre, i, o2, c))
                made.append((at, to, (left * width**2 + centre * width + i) if centre else 0, o if centre else 0, cost if centre else 0.0))
        return _rows(sorted(made), ends)

    return _graphwise(run, df, keys)


# decoding


def decode_frames(edges: list[Edge], finals: dict[int, float], scores: list, beam: float, lm_scale: float, word_penalty: float, most: int | None) -> dict:
    """Token passing over one utterance: an edge with input symbol i takes a frame at scores[frame][i - 1] plus lm_scale times its
    cost; an output symbol adds word_penalty; edges without input take no frame. Tokens beyond the beam, or beyond the `most` best, go."""
    out = _out(edges)
    tokens: dict[int, tuple] = {0: (0.0, None)}

    def closed(tokens: dict[int, tuple]) -> dict[int, tuple]:
        todo = list(tokens)
        while todo:
            s = todo.pop()
            cost, trail = tokens[s]
            for e in out.get(s, ()):
                if not e[2]:
                    new = cost + lm_scale * e[4] + (word_penalty if e[3] else 0)
                    if e[1] not in tokens or new < tokens[e[1]][0] - 1e-12:
                        tokens[e[1]] = (new, (trail, e[3]) if e[3] else trail)
                        todo.append(e[1])
        return tokens

    tokens = closed(tokens)
    active = 0
    for frame in scores:
        new: dict[int, tuple] = {}
        for s, (cost, trail) in tokens.items():
            for e in out.get(s, ()):
                if e[2]:
                    c = cost + frame[e[2] - 1] + lm_scale * e[4] + (word_penalty if e[3] else 0)
                    if e[1] not in new or c < new[e[1]][0]:
                        new[e[1]] = (c, (trail, e[3]) if e[3] else trail)
        new = closed(new)
        if not new:
            return {"cost": None, "words": [], "active": active}
        top = min(c for c, _ in new.values())
        keep = sorted((c, s) for s, (c, _) in new.items() if c <= top + beam)[:most]
        tokens = {s: new[s] for _, s in keep}
        active += len(tokens)
    ends = [(c + lm_scale * finals[s], s) for s, (c, _) in tokens.items() if s in finals]
    if not ends:
        return {"cost": None, "words": [], "active": active}
    cost, s = min(ends)
    words, trail = [], tokens[s][1]
    while trail:
        words.append(trail[1])
        trail = trail[0]
    return {"cost": cost, "words": words[::-1], "active": active}


def decode_utterances(scored: DataFrame, graph: list[Edge], finals: dict[int, float], key: str = "utt", beam: float = 100.0, lm_scale: float = 12.0, word_penalty: float = 0.0, most: int | None = None) -> DataFrame:
    """Best word sequence of each utterance's frames (key, n, scores: costs of input symbols 1, 2, ...) over a graph that all share: the
    graph is a model and is sent once to each task; an utterance's frames pass in order with its tokens. (key, cost, words, active);
    cost is null where no path fits."""
    sent = scored.sparkSession.sparkContext.broadcast((graph, finals))

    def run(rows: list[dict]) -> list[dict]:
        return [decode_frames(*sent.value, [r["scores"] for r in sorted(rows, key=lambda r: r["n"])], beam, lm_scale, word_penalty, most)]

    return per_group(scored.select(key, "n", "scores"), [key], run, "cost double, words array<long>, active long")
