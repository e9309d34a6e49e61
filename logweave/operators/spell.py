"""Spell: groups by longest common subsequence, over the whole log.

There is a single route, so parallelism comes from the blocks of ``replay`` alone. A line meets only templates that an index
of their tokens finds, so free text, where every line opens a group, does not compare each line with all before it.

*Free text.* A group that no line has joined shares as many tokens with the first line to join it as both ask for. So a line that is not
alike to any other (``overlap``, in blocks, in parallel) opens a group that keeps its text, and only its
constants matter to later lines. Where few lines of a sample are alike, all lines are compared that way first, and one pass in their order looks for
templates among the groups of the others only.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.functions.text import WILDCARD
from logweave.operators.overlap import BYTES, ROWS, alike, alike_rows, keys_of
from logweave.operators.replay import BLOCK_LINES, Group, blocks_needed, replay, root_of, size_of, with_templates
from logweave.session import materialize

FREE_LINES = 10_000  # shorter logs are replayed as they are
FREE_SAMPLE = 2048
FREE_SHARE = 0.25  # of lines that are alike to another one, at most


class _Prefixes:
    """The prefixes of the templates' constants, each with the number of templates that share it.

    A prefix is a number, ``after`` leads from one prefix and a token to the next. ``owner`` holds the template
    that was the last to end at a prefix, which may have changed since. Prefixes that one template has alone are not laid out: ``after``
    leads to that ``(constants, length of the prefix, template)`` instead, so free text costs one entry a line. Of a line that no
    other line can join it is ``(text, length of the prefix, None)``.
    """

    def __init__(self):
        self.after: dict[tuple[int, str], int | tuple[list[str] | str, int, Group | None]] = {}
        self.sharing: dict[int, int] = {}
        self.owner: dict[int, Group] = {}
        self._names = count(1)

    def _laid_out(self, step: tuple[int, str]) -> int:
        """The prefix behind ``step``; one that a template had alone becomes a number."""
        further = self.after[step]
        if isinstance(further, tuple):
            constants, length, group = further
            self.after[step] = further = next(self._names)
            self.sharing[further] = 1
            tokens = constants if group is not None else constants.split(" ")
            if length < len(tokens):
                self.after[further, tokens[length]] = (constants, length + 1, group)
            elif group is not None:
                self.owner[further] = group
        return further

    def add(self, constants: list[str], group: Group) -> None:
        at = 0
        for i, token in enumerate(constants, 1):
            if (at, token) not in self.after:
                self.after[at, token] = (constants, i, group)
                return
            at = self._laid_out((at, token))
            self.sharing[at] += 1
        self.owner[at] = group

    def pass_through(self, tokens: list[str], content: str) -> None:
        """Add the constants of a line that no other line can join, which owns no prefix."""
        at = 0
        for i, token in enumerate(tokens, 1):
            if (at, token) not in self.after:
                self.after[at, token] = (content, i, None)
                return
            at = self._laid_out((at, token))
            self.sharing[at] += 1
        self.owner.pop(at, None)

    def remove(self, constants: list[str]) -> None:
        """Forget the prefixes that only this template has; one that others share keeps its owner."""
        at, alone = 0, False
        for token in constants:
            if (at, token) not in self.after:
                return
            further = self.after[at, token]
            if isinstance(further, tuple):
                del self.after[at, token]
                return
            alone = alone or self.sharing[further] == 1
            if alone:
                del self.after[at, token], self.sharing[further]
                self.owner.pop(further, None)
            else:
                self.sharing[further] -= 1
            at = further

    def along(self, tokens: list[str], needed: float) -> Group | None:
        """The first template to end where the tokens lead, those skipped that lead nowhere, after ``needed`` steps or more."""
        at, tail, matched = 0, None, 0
        for token in tokens:
            if matched >= needed:
                owner = self.owner.get(at) if tail is None else tail[2] if matched == len(tail[0]) else None
                if owner is not None:
                    return owner
            if tail is not None:
                matched += matched < len(tail[0]) and tail[0][matched] == token
                continue
            further = self.after.get((at, token))
            if further is not None:
                matched += 1
                if isinstance(further, tuple):
                    if further[2] is None:
                        return None
                    tail = further
                else:
                    at = further
        return None


_NEVER = 1 << 30
_MORE_PLACES = 1024


class _SharedTokens:
    """Templates by their tokens; repeated ones count apart.

    ``first`` lists for every token the places of the templates that hold it, ``groups`` the template of a place. A template
    that changes moves to a new place. A line with ``least`` tokens in common with a template meets it in the lists of any
    ``n - least + 1`` of its ``n`` tokens, so the shortest lists are counted, and those that may still
    have enough in common are looked up in the longer ones, until the number in common is known.
    """

    def __init__(self, least):
        self.least = least  # of a length, the tokens that must be common
        self.first: dict[tuple[str, int], array] = {}
        self.groups: list[Group | None] = []
        self.needed = array("i")  # by a template at that place
        self.length = array("i")
        self.empty: list[Group] = []  # templates without tokens
        self.longest = 0  # tokens that any template ever had
        self.gone = 0  # places left
        self.met = 0  # templates compared with lines

    @staticmethod
    def _numbered(tokens: list[str]) -> list[tuple[str, int]]:
        seen: dict[str, int] = {}
        numbered = []
        for t in tokens:
            seen[t] = seen.get(t, -1) + 1
            numbered.append((t, seen[t]))
        return numbered

    def add(self, group: Group) -> None:
        if not group.tokens:
            self.empty.append(group)
            return
        group.view = len(self.groups)
        for key in self._numbered(group.tokens):
            if key not in self.first:
                self.first[key] = array("i")
            self.first[key].append(group.view)
        self.groups.append(group)
        self.longest = max(self.longest, len(group.tokens))
        self.needed.append(self.least(len(group.tokens)))
        self.length.append(len(group.tokens))

    def remove(self, group: Group) -> None:
        if not group.tokens:
            self.empty.remove(group)
            return
        self.groups[group.view] = None
        self.needed[group.view] = _NEVER
        self.gone += 1
        if self.gone > 1000 + len(self.groups) // 2:
            here = [g for g in self.groups if g is not None]
            self.first, self.groups, self.needed, self.length, self.gone = {}, [], array("i"), array("i"), 0
            for g in here:
                self.add(g)

    def sharing(self, tokens: list[str]) -> list[Group]:
        """All templates with enough tokens in common with a line, in whatever order, the oldest first."""
        least = self.least(len(tokens))
        if self.longest < least:
            return []
        lists = sorted((self.first[key] for key in self._numbered(tokens) if key in self.first), key=len)
        if len(lists) < least:
            return []
        counted = len(lists) - least + 1
        places = sum(map(len, lists[:counted]))
        room = places + _MORE_PLACES
        while counted < len(lists) and places + len(lists[counted]) <= room:
            places += len(lists[counted])
            counted += 1
        at, common = np.unique(np.frombuffer(b"".join(lists[:counted]), np.int32), return_counts=True)
        left = len(lists) - counted
        needed = np.maximum(np.frombuffer(self.needed, np.int32)[at], least)
        enough = common + left >= needed
        at, common, needed = at[enough], common[enough], needed[enough]
        for longer in lists[counted:]:
            if not len(at):
                break
            longer = np.frombuffer(longer, np.int32)
            left -= 1
            common += longer[np.minimum(np.searchsorted(longer, at), len(longer) - 1)] == at
            enough = common + left >= needed
            at, common, needed = at[enough], common[enough], needed[enough]
        self.met += len(at)
        return sorted((self.groups[k] for k in at.tolist()), key=_age)


def _age(group: Group) -> tuple:
    return group.leader is not None, group.leader


def _constants(template: list[str]) -> list[str]:
    return [t for t in template if t != WILDCARD]


class SpellMiner:
    def __init__(self, sim_thr: float):
        self.threshold = np.float32(sim_thr)
        self.prefixes = _Prefixes()
        self._bounds: dict[int, float] = {}
        self.index = _SharedTokens(self._least)

    def _needed(self, n: int) -> float:
        if n not in self._bounds:
            self._bounds[n] = float(self.threshold * np.float32(n))
        return self._bounds[n]

    def _least(self, n: int) -> int:
        return max(math.ceil(self._needed(n)), 1)

    def find(self, tokens: list[str]) -> Group | None:
        needed = self._needed(len(tokens))
        found = self.prefixes.along(tokens, needed)
        if found is None:
            alike = self.index.sharing(tokens)
            found = self._by_subsequence(tokens, needed, alike) or self._by_lcs(tokens, alike)
        return found

    def open(self, group: Group) -> bool:
        self.index.add(group)
        self.prefixes.add(_constants(group.tokens), group)
        return True

    def absorb(self, group: Group, tokens: list[str]) -> bool:
        if _covers(group.tokens, tokens):
            return False
        template = aligned(common_subsequence(tokens, group.tokens), group.tokens)
        if template == group.tokens:
            return False
        self.prefixes.remove(_constants(group.tokens))
        self.index.remove(group)
        group.tokens = template
        self.index.add(group)
        self.prefixes.add(_constants(template), group)
        return True

    def _by_subsequence(self, tokens, needed, alike):
        if needed <= 0 and self.index.empty:
            alike = sorted([*self.index.empty, *alike], key=_age)
        for group in alike:
            if needed <= len(group.tokens) <= len(tokens) and _is_subsequence(group.tokens, tokens):
                return group
        return None

    def _by_lcs(self, tokens, alike):
        if not alike:
            return None
        positions: dict[str, int] = {}
        for i, token in enumerate(tokens):
            positions[token] = positions.get(token, 0) | (1 << i)
        own = self._least(len(tokens))
        best, best_rank = None, (0, 0)
        for group in alike:
            template = group.tokens
            least = max(own, self._least(len(template)))
            if least > min(len(tokens), len(template)):
                continue
            length = _lcs_length(positions, len(tokens), template)
            # the longest wins, then the shorter template, then the older one
            if length >= least and (best is None or (length, -len(template)) > best_rank):
                best, best_rank = group, (length, -len(template))
        return best


def _is_subsequence(short, tokens) -> bool:
    rest = iter(tokens)
    return all(t in rest for t in short)


def _covers(template: list[str], tokens: list[str]) -> bool:
    """A quick sufficient test that a line leaves its template as it is."""
    if WILDCARD in tokens or any(a == b == WILDCARD for a, b in zip(template, template[1:])):
        return False
    return _is_subsequence([t for t in template if t != WILDCARD], tokens)


def _lcs_length(positions: dict[str, int], length: int, other: list[str]) -> int:
    """Bit-parallel LCS length: bit i of ``row`` is 0 where the common subsequence grows at token i."""
    full = (1 << length) - 1
    row = full
    for token in other:
        at = positions.get(token)
        if at is not None:
            hit = row & at
            row = ((row + hit) | (row - hit)) & full
    return length - row.bit_count()


def common_subsequence(a: list[str], b: list[str]) -> list[str]:
    """One longest common subsequence; of several, the one that ends earliest in ``a``, then in ``b``."""
    rows = [[0] * (len(b) + 1)]
    for x in a:
        above, left, row = rows[-1], 0, [0]
        for j, y in enumerate(b):
            left = above[j] + 1 if x == y else max(left, above[j + 1])
            row.append(left)
        rows.append(row)
    i, j, out = len(a), len(b), []
    while i and j:
        if rows[i][j] == rows[i - 1][j]:
            i -= 1
        elif rows[i][j] == rows[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append(a[i])
    return out[::-1]


def aligned(common: list[str], template: list[str]) -> list[str]:
    """``common`` in the order of ``template``, each gap as one wildcard."""
    if not common:
        return []
    out, taken = [], 0
    for token in template:
        if taken < len(common) and token == common[taken]:
            taken += 1
        else:
            token = WILDCARD
        if token != WILDCARD or not out or out[-1] != WILDCARD:
            out.append(token)
    return out


def _looks_free(lines: DataFrame, least) -> bool:
    """Whether few lines of a sample are alike."""
    sample = lines.orderBy(F.xxhash64("LineID", "content")).limit(FREE_SAMPLE).select("content").toArrow()
    found, _ = alike(keys_of(sample.column("content").to_pylist()), None, least)
    return found.mean() <= FREE_SHARE


_TEMPLATES = "LineID long, Template string"


def _one_pass(sim_thr: float):
    """Lines (``LineID``, ``content``, ``alone``) in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        miner = SpellMiner(sim_thr)
        one: dict[str, str] = {}
        ids, groups = [], []
        for batch in batches:
            own_ids, own_texts = [], []
            for line_id, content, alone in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = content.split(" ")
                group = miner.find(tokens)
                if group is not None:
                    miner.absorb(group, tokens)
                elif alone:
                    miner.prefixes.pass_through(tokens, content)
                    own_ids.append(line_id)
                    own_texts.append(content)
                    continue
                else:
                    group = Group(line_id, [one.setdefault(t, t) for t in tokens])
                    miner.open(group)
                ids.append(line_id)
                groups.append(group)
            yield _named(own_ids, own_texts)
        for begin in range(0, len(ids), 8192):
            yield _named(ids[begin : begin + 8192], [" ".join(g.tokens) for g in groups[begin : begin + 8192]])

    return run


def _named(ids: list, texts: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], ["LineID", "Template"])


def _free_text(lines: DataFrame, sim_thr: float, n_lines: int, n_bytes: int) -> DataFrame | None:
    """``(LineID, Template)``; ``None`` if many lines are alike."""
    least = SpellMiner(sim_thr)._least
    rows = materialize(lines.select("LineID", "content").withColumn("row", F.monotonically_increasing_id()))
    # a literal wildcard may equal one of a template
    wild = F.array_contains(F.split("content", " "), WILDCARD)
    # ten pairs of blocks at least, so that a short log uses several cores too
    blocks = max(4, -(-n_lines // ROWS), -(-n_bytes // BYTES))
    one = rows.withColumn("route", F.lit("")).withColumn("blocks", F.lit(blocks).cast("long"))
    met = alike_rows(one, blocks * (blocks + 1) // 2, least).withColumn("met", F.lit(True))
    marked = materialize(rows.join(met, "row", "left").select("LineID", "content", (F.col("met").isNull() & ~wild).alias("alone")))
    if marked.where("not alone").count() > 2 * FREE_SHARE * n_lines:
        return None
    return marked.repartition(1).sortWithinPartitions("LineID").mapInArrow(_one_pass(sim_thr), _TEMPLATES)


def mine_spell(df: DataFrame, sim_thr: float = 0.5, block_lines: int = BLOCK_LINES, log: str | None = None) -> DataFrame:
    """``log`` names a column that tells several logs apart; each is a route of its own."""
    lines = df.where(F.col("content").isNotNull()).select(
        root_of(log).alias("route"), F.lit(0).alias("level"), "LineID", "content"
    )
    n_lines, n_bytes = size_of(lines)
    if log is None and sim_thr > 0 and n_lines >= FREE_LINES and _looks_free(lines, SpellMiner(sim_thr)._least):
        mined = _free_text(lines, sim_thr, n_lines, n_bytes)
        if mined is not None:
            return with_templates(df, mined, log)
    mined = replay(lines, lambda level: SpellMiner(sim_thr), blocks_needed(n_lines, n_bytes, block_lines))
    return with_templates(df, mined, log)
