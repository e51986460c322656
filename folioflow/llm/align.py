"""Sentence pairs of bilingual rows (problem 3).

Every row is a bitext space of its own: points are tokens of the original and of the translation
that match by form (names, numbers) or by the lexicon. Chains are searched along the original: a
point joins the chain whose line (of the languages' slope) it is nearest to, if it lies within the
residual and in reach of the chain's last point, or begins one. A chain must keep to the slope, or
it is divided; what weighs too little to be a chain is searched again in wider rectangles, and what is left
then is noise. Chains far off the main diagonal are inversions and stand like all others. Chains are
then converted into blocks of sentences, strongest first: what a taken block covers is
noise for all others, so repeated words give no second pair. A translated sentence whose rest is
covered by another original's chain is a merger; a sentence that only covers what its
neighbour's original still lacks is the rest of a division.

Defined results: sentences count from 0 in the consistent form of the text; null or blank
sides give no pair; repeated rows are aligned each; ties go to the pair nearest the diagonal.
Work is one pass over each row: a text of any length is held by one task, with all its points; a
token that comes s and t times on the sides has s * t of them, and the search is linear in points.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitext import Lexicon, match, plain, sentences

#: Residual of a chain by the mean length of a translated sentence, from narrow to wide; reach by that of an original one.
RESIDUALS, REACH = (0.25, 0.5, 0.75), 2.0
#: How far a chain's slope may stray, as a share of the languages'.
STRAY = 0.5
LEAST, LEAST_SHARE, NEAR = 3.0, 0.2, 4

Point = tuple[float, float, float, int]  # x, offset from the diagonal, weight, number


def _keeps_slope(chain: list[Point], slope: float, residual: float) -> bool:
    """Whether the line through the chain (least squares) keeps to the slope, as far as its length can tell."""
    n = len(chain)
    span = chain[-1][0] - chain[0][0]
    mx, md = math.fsum(p[0] for p in chain) / n, math.fsum(p[1] for p in chain) / n
    var = math.fsum((p[0] - mx) ** 2 for p in chain)
    if not var or span * slope <= residual:
        return True
    stray = math.fsum((p[0] - mx) * (p[1] - md) for p in chain) / var
    rms = math.sqrt(math.fsum((p[1] - md - stray * (p[0] - mx)) ** 2 for p in chain) / n)
    return abs(stray) <= STRAY * slope and rms <= residual


def _divided(chain: list[Point], slope: float, residual: float) -> list[list[Point]]:
    """The chain, or its parts: it is cut at its largest jump until every part keeps to the slope."""
    todo, out = [chain], []
    while todo:
        c = todo.pop()
        if len(c) < 3 or _keeps_slope(c, slope, residual):
            out.append(c)
            continue
        at = max(range(1, len(c)), key=lambda k: abs(c[k][1] - c[k - 1][1]))
        todo += [c[:at], c[at:]]
    return out


def chains(points: list[Point], slope: float, reach: float, residuals: list[float], least: float = LEAST) -> list[list[Point]]:
    """Slope-consistent chains of points sorted by x, the narrow ones first; points in none are noise."""
    out, rest = [], points
    for residual in residuals:
        done: list[list[Point]] = []
        at: dict[int, list] = {}  # place of the chain's line -> [mean offset, points]
        for p in rest:
            here = int(p[1] // residual)
            near = None
            for k in (here - 1, here, here + 1):
                c = at.get(k)
                if c is None:
                    continue
                if p[0] - c[1][-1][0] > reach:
                    done.append(at.pop(k)[1])
                elif abs(p[1] - c[0]) <= residual and (near is None or abs(p[1] - c[0]) < abs(p[1] - at[near][0])):
                    near = k
            c = at.pop(near) if near is not None else [p[1], []]
            c[1].append(p)
            c[0] += 0.3 * (p[1] - c[0])
            k = int(c[0] // residual)
            if k in at:
                done.append(at.pop(k)[1])
            at[k] = c
        done += [c[1] for c in at.values()]
        left = []
        for c in done:
            for part in _divided(c, slope, residual):
                if math.fsum({p[3]: p[2] for p in part}.values()) >= least:
                    out.append(part)
                else:
                    left += part
        rest = sorted(left)
    return out


def _owner(spans: list[tuple[int, int]], positions: list[int]) -> list[int]:
    """The sentence of each position; spans and positions are in order."""
    out, k = [], 0
    for p in positions:
        while k + 1 < len(spans) and p >= spans[k + 1][0]:
            k += 1
        out.append(k)
    return out


def align(source: str | None, target: str | None, lexicon: Lexicon) -> list[tuple[int, int]]:
    source, target = plain(source), plain(target)
    s_spans, t_spans = sentences(source), sentences(target)
    if not s_spans or not t_spans:
        return []
    m = match(source, target, lexicon)
    s_of, t_of = _owner(s_spans, [x.start() for x in m.src]), _owner(t_spans, [x.start() for x in m.tgt])
    slope = len(target) / max(1, len(source))

    # What a translation leaves out changes the slope of the text, but not that of its sentences.
    space = sorted((float(m.src[i].start()), m.tgt[j].start() - lexicon.ratio * m.src[i].start(), w, n) for n, (i, j, w) in enumerate(m.points))
    mean_t, mean_s = len(target) / len(t_spans), len(source) / len(s_spans)
    cells: dict[tuple[int, int], list] = defaultdict(list)
    for c in chains(space, lexicon.ratio, REACH * mean_s, [r * mean_t for r in RESIDUALS]):
        for *_, n in c:
            i, j, w = m.points[n]
            cells[s_of[i], t_of[j]].append((i, j, w))
    for held in cells.values():
        held.sort(key=lambda p: (p[0], abs(m.src[p[0]].start() * slope - m.tgt[p[1]].start()), p[1], p[2]))

    total = [0.0] * len(t_spans)  # weight that would explain a translated sentence wholly
    for j in range(len(m.tgt)):
        total[t_of[j]] += 2.0

    whole = [0.0] * len(s_spans)
    for i, w in enumerate(m.src_weight):
        whole[s_of[i]] += w

    def block(cell: tuple[int, int], used_s: set[int], used_t: set[int]) -> tuple[float, set[int], set[int]]:
        """(weight, source tokens, target tokens) of the block's chains without used tokens."""
        by_source: dict[int, tuple[float, int]] = {}
        strong = []
        for i, j, w in cells[cell]:
            if i in used_s or j in used_t:
                continue
            if w >= 0.6 * m.src_weight[i]:
                strong.append((i, j))
            if w > by_source.get(i, (0.0, 0))[0]:
                by_source[i] = (w, j)
        # A word covers what stands around its own point, not where it comes again.
        covered = {j for i, j in strong if abs(j - by_source[i][1]) <= NEAR}
        return sum(w for w, _ in by_source.values()), set(by_source), covered

    used_s: set[int] = set()
    used_t: dict[int, set[int]] = defaultdict(set)
    owner: dict[int, list[int]] = defaultdict(list)
    out: set[tuple[int, int]] = set()
    blocks = {c: block(c, used_s, set()) for c in cells}

    def distance(c: tuple[int, int]) -> float:
        return abs((s_spans[c[0]][0] * slope - t_spans[c[1]][0]) / max(1, len(target)))

    def rank(c: tuple[int, int]) -> float:
        bonus = 1.5 if c[0] in owner[c[1] - 1] or c[0] in owner[c[1] + 1] else 0.0
        return blocks[c][0] + bonus - 2.0 * distance(c)

    heap = [(-rank(c), distance(c), c) for c in cells if blocks[c][0] >= LEAST]
    heapq.heapify(heap)
    closed: set[tuple[int, int]] = set()
    while heap:
        key, d, c = heapq.heappop(heap)
        if c in closed:
            continue
        fresh = block(c, used_s, used_t[c[1]])
        blocks[c] = fresh
        if fresh[0] < LEAST:
            closed.add(c)
            continue
        now = -rank(c)
        if now > key + 1e-9 and heap and now > heap[0][0]:
            heapq.heappush(heap, (now, d, c))
            continue
        closed.add(c)
        weight, si, tj = fresh
        share = weight / max(total[c[1]], 1.0)
        if not owner[c[1]]:
            ok = share >= LEAST_SHARE or (weight >= 9.0 and share >= 0.12) or weight >= 0.5 * whole[c[0]]
        else:  # a merger: the rest of this translated sentence renders another original
            ok = weight >= 0.45 * max(whole[c[0]], 1.0) and (weight >= 6.0 or weight >= 0.6 * whole[c[0]])
        if ok:
            out.add(c)
            owner[c[1]].append(c[0])
            used_s |= si
            used_t[c[1]] |= tj
            for near_c in ((c[0], c[1] - 1), (c[0], c[1] + 1)):  # neighbours gain: the rest of a division
                if near_c in blocks and near_c not in closed:
                    heapq.heappush(heap, (-rank(near_c), distance(near_c), near_c))
    return sorted(out)


def sentence_pairs(rows: DataFrame, lexicon: Lexicon, id_col: str = "row_id", source_col: str = "original_text", target_col: str = "translated_text") -> DataFrame:
    """id, source_sentence, target_sentence of each row."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)  # bounded by the lexicon's support

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filter(len, it):
            out = [(r, i, j) for r, s, t in pdf.itertuples(index=False) for i, j in align(s, t, shared.value)]
            yield pd.DataFrame(out, columns=[id_col, "source_sentence", "target_sentence"])

    chosen = rows.select(F.col(id_col).cast("long"), F.col(source_col).cast("string"), F.col(target_col).cast("string"))
    return chosen.mapInPandas(run, f"{id_col} long, source_sentence int, target_sentence int")


def found(paragraphs: DataFrame, lexicon: Lexicon) -> DataFrame:
    return sentence_pairs(paragraphs.filter(F.col("status") == "edited"), lexicon)
