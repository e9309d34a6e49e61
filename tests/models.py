"""Plain sequential models of the five miners, one line after the other, to compare the Spark jobs with."""

import math

import numpy as np

W = "<#*#>"
f32 = np.float32


class _Cluster:
    def __init__(self, tokens):
        self.tokens = list(tokens)


def _walk(root, keys):
    node = root
    for k in keys:
        if k in node["next"]:
            node = node["next"][k]
        elif W in node["next"]:
            node = node["next"][W]
        else:
            return None
    return node


def _tree(lines, depth, children, thr, with_count, sim, merge):
    root = {"next": {}, "clusters": []}
    out = []
    for tokens in lines:
        path = ([str(len(tokens))] if with_count else []) + list(tokens)
        keys = path[: depth - 1]
        node = _walk(root, keys)
        best, rank = None, (f32(-1), 0)
        if node is not None:
            for c in node["clusters"]:
                s, p = sim(tokens, c.tokens)
                if s > rank[0] or (s == rank[0] and p > rank[1]):
                    best, rank = c, (s, p)
        if best is not None and rank[0] > f32(thr):
            best.tokens = merge(tokens, best.tokens)
        else:
            best = _Cluster(tokens)
            node = root
            for k in keys:
                if k not in node["next"]:
                    if len(node["next"]) + 1 >= children:
                        k = W
                    if k not in node["next"]:
                        node["next"][k] = {"next": {}, "clusters": []}
                node = node["next"][k]
            if len(path) >= depth:
                node["clusters"].append(best)
        out.append(best)
    return [" ".join(c.tokens) for c in out]


def _positions(a, b):
    out = list(a)
    for i in range(min(len(a), len(b))):
        if a[i] != b[i]:
            out[i] = W
    return out


def drain(lines, depth=4, children=100, sim_thr=0.4):
    def sim(a, b):
        same = params = 0
        for x, y in zip(a, b):
            if y == W:
                params += 1
            elif x == y:
                same += 1
        return f32(same) / f32(len(a)), params

    return _tree(lines, depth, children, sim_thr, True, sim, _positions)


def jaccard_drain(lines, depth=4, children=100, sim_thr=0.4):
    def sim(a, b):
        sa, sb = set(a), set(x for x in b if x != W)
        union = len(sa | sb)
        s = f32(len(sa & sb)) / f32(union) if union else f32(1)
        return min(s * f32(1.3), f32(1)), sum(x == W for x in b)

    def merge(a, b):
        if len(a) == len(b):
            return _positions(a, b)
        long, short = (a, b) if len(a) > len(b) else (b, a)
        return [x if x in short else W for x in long]

    return _tree(lines, depth, children, sim_thr, False, sim, merge)


def _common(a, b):
    """The common subsequence of two token lists by its recursive definition, the shorter prefix of ``a`` first."""
    from functools import cache

    @cache
    def of(i, j):
        if not i or not j:
            return ()
        ways = [of(i - 1, j), of(i, j - 1)]
        if a[i - 1] == b[j - 1]:
            ways.append((*of(i - 1, j - 1), a[i - 1]))
        longest = max(map(len, ways))
        return next(w for w in ways if len(w) == longest)

    return of(len(a), len(b))


def _holds(tokens, short):
    rest = iter(tokens)
    return all(t in rest for t in short)


def _generalised(template, common):
    """What is common stays, every run of other tokens is one wildcard; nothing stays if nothing is common."""
    from itertools import groupby

    left = list(common)
    signs = [left.pop(0) if left and t == left[0] else W for t in template] if common else []
    return [t for sign, run in groupby(signs) for t in ([W] if sign == W else run)]


def spell(lines, sim_thr=0.5):
    """The rules of the miner, stated over all templates so far.

    ``shared`` counts the templates that begin with a run of constants, ``ends`` names the one that ended there last.
    """
    from collections import Counter

    thr, pool, shared, ends, out = f32(sim_thr), [], Counter(), {}, []

    def prefixes(cluster):
        constants = tuple(t for t in cluster.tokens if t != W)
        return [constants[: k + 1] for k in range(len(constants))]

    def enter(cluster):
        own = prefixes(cluster)
        shared.update(own)
        ends[own[-1] if own else ()] = cluster

    def leave(cluster):
        for k, prefix in enumerate(prefixes(cluster)):
            if shared[prefix] <= 1:
                for gone in prefixes(cluster)[k:]:
                    shared.pop(gone, None)
                    ends.pop(gone, None)
                return
            shared[prefix] -= 1

    def by_prefix(tokens, need):
        seen = ()
        for t in tokens:
            if seen in ends and f32(len(seen)) >= need:
                return ends[seen]
            seen = (*seen, t) if shared[(*seen, t)] else seen
        return None

    def by_holding(tokens, need):
        return next((c for c in pool if f32(len(c.tokens)) >= need and _holds(tokens, c.tokens)), None)

    def by_common(tokens, need):
        sized = [(len(_common(tokens, c.tokens)), -len(c.tokens), -k, c) for k, c in enumerate(pool)]
        fit = [s for s in sized if s[0] and s[0] >= max(math.ceil(need), math.ceil(thr * f32(-s[1])))]
        return max(fit, key=lambda s: s[:3])[3] if fit else None

    for tokens in lines:
        need = thr * f32(len(tokens))
        cluster = by_prefix(tokens, need) or by_holding(tokens, need) or by_common(tokens, need)
        if cluster is None:
            cluster = _Cluster(tokens)
            pool.append(cluster)
            enter(cluster)
        else:
            changed = _generalised(cluster.tokens, _common(tokens, cluster.tokens))
            if changed != cluster.tokens:
                leave(cluster)
                cluster.tokens = changed
                enter(cluster)
        out.append(cluster)
    return [" ".join(c.tokens) for c in out]


def ael(lines, cluster_thr=2, merge_thr=1.0):
    import re

    bins = {}
    for t in lines:
        key = (len(t), int(bool(re.search("<#.*#>", " ".join(t)))))
        bins.setdefault(key, {}).setdefault(tuple(t), None)
    template = {}
    for contents in bins.values():
        contents = list(contents)
        if len(contents) <= cluster_thr:
            template.update({c: " ".join(c) for c in contents})
            continue
        groups = []
        for c in contents:
            for g in groups:
                diff = sum(x != y for x, y in zip(g[0], c))
                if diff > 0 and f32(diff) / f32(len(c)) <= f32(merge_thr):
                    g.append(c)
                    break
            else:
                groups.append([c])
        for g in groups:
            text = " ".join(x[0] if len(set(x)) == 1 else W for x in zip(*g))
            template.update({c: text for c in g})
    return [template[tuple(t)] for t in lines]


def brain(lines, var_thr=2):
    from collections import Counter, defaultdict

    out = [None] * len(lines)
    by_length = defaultdict(list)
    for i, t in enumerate(lines):
        by_length[len(t)].append(i)
    for length, rows in by_length.items():
        freq = [Counter(lines[i][c] for i in rows) for c in range(length)]
        families = defaultdict(list)
        for i in rows:
            fs = [freq[c][lines[i][c]] for c in range(length)]
            hist = sorted(Counter(fs).items())
            hist.sort(key=lambda x: -x[1])
            top = f32(max(fs)) * f32(0.5)
            families[next(h for h in hist if f32(h[0]) >= top)].append(i)
        for (root, _), members in families.items():
            wild = set()
            for c in range(length):
                high = max(freq[c][lines[i][c]] for i in members)
                tokens = {lines[i][c] for i in members}
                if high > root and len(tokens) > 1 or high < root and len(tokens) >= var_thr:
                    wild.add(c)
            for i in members:
                out[i] = " ".join(W if c in wild else t for c, t in enumerate(lines[i]))
    return out
