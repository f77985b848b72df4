"""Passages of evaluation items inside a training corpus.

Items and documents are reduced to what survives resetting: markup, escapes, hidden characters, case,
accents, look-alike letters, blanks and punctuation go. Shared character q-grams are looked up in an
index of all items and counted in overlapping diagonal bands; regions that keep fewer q-grams than the
q-gram lemma demands of a passage within the edit budget are dropped. What is left is verified by an
alignment that is anchored at the q-grams and banded in the gaps between them. Items compete for the
places of a document: wording that several items share speaks only for the item that explains more.

The lemma: an altered place of c characters destroys at most c + Q - 1 of the n - Q + 1 q-grams of a
passage of n characters. A passage is within the budget while these losses make up at most LOSS of its
characters (for example one altered character in fourteen, or a sixth of the words replaced by others); it then keeps
at least (1 - LOSS) n - Q + 1 q-grams. Edits of a verified passage may make up EDIT_SHARE of it.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Sequence
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casemill.llm.chars import HIDDEN_OR_MARK

Q = 7
BAND = 64
#: A passage counts from this many words of the item on ("about fifteen"); a whole item always does.
MIN_WORDS = 13
#: Share of a passage's q-grams that altered places may destroy, and edits allowed per character of a passage.
LOSS, EDIT_SHARE = 0.5, 0.34
#: The most characters of the item that may be missing at one place, and the most that may stand in between.
GAP, INTERRUPTION = 48, 400
#: Characters of items that are indexed and broadcast at once; more items are taken in blocks.
BLOCK_CHARS = 4_000_000
#: Characters of documents that are hashed at once in a worker, and cells of band counts held at once.
CHUNK_CHARS, CELLS = 1_000_000, 8_000_000
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>|<!--.{0,200}?-->")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")
_NOT_ALNUM = re.compile(r"[\W_]+")
#: Words; scripts without blanks count two characters as one.
_WORD = re.compile(r"[぀-ヿ㐀-鿿]{1,2}|[^\W_぀-ヿ㐀-鿿]+")
#: Look-alike letters of other scripts, as fixed values.
LOOKALIKES = dict(zip("аеорсухіјѕԁһӏмткнвгпιοαρτυκνηε", "aeopcyxijsdhlmtkhbrniaaptuknne"))
LOOKALIKES |= {"ο": "o", "ι": "i", "α": "a", "ε": "e", "ν": "v", "п": "n", "г": "r", "ß": "ss", "ø": "o", "ł": "l", "œ": "oe", "æ": "ae", "ı": "i"}
_MAP, _ALIKE = str.maketrans(LOOKALIKES), re.compile("[" + "".join(LOOKALIKES) + "]")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str) -> str:
    """Lower-case text without markup, escapes, hidden characters, accents and look-alikes; blanks stay."""
    if "\\" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1], 16)), text).replace("\\n", " ").replace("\\t", " ").replace('\\"', '"')
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("", text)
    if text.isascii():
        return text.lower()
    text = HIDDEN_OR_MARK.sub("", unicodedata.normalize("NFKD", text).casefold())
    return text.translate(_MAP) if _ALIKE.search(text) else text


def compact(text: str) -> str:
    """Only the letters and digits of the normal form."""
    return _NOT_ALNUM.sub("", normal(text))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def qgram_hashes(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of the q-gram that starts at each position."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, dtype=np.uint64)
        for k in range(q):
            out = out * _BASE + (codes[k : k + n] ^ np.uint64(0x5BD1E995))
        out ^= out >> np.uint64(29)
    return out


class ItemIndex:
    """The q-grams of a block of items with their places, and where the words of each item start."""

    def __init__(self, items: Sequence[tuple[int, str]]):
        self.ids, self.texts, self.starts = [], [], []
        hashes, places, owners, least = [], [], [], []
        for item_id, text in items:
            words = _WORD.findall(normal(text))
            flat = "".join(words)
            if len(flat) < Q:
                continue
            starts, at = [], 0
            for w in words:
                starts.append(at)
                at += len(w)
            h = qgram_hashes(_codes(flat))
            hashes.append(h)
            places.append(np.arange(len(h)))
            owners.append(np.full(len(h), len(self.ids)))
            ends = [*starts[1:], at]
            # The shortest passage that counts, and the q-grams it keeps within the budget.
            shortest = min(ends[i + MIN_WORDS - 1] - starts[i] for i in range(len(starts) - MIN_WORDS + 1)) if len(starts) >= MIN_WORDS else at
            least.append(max(1, int(np.ceil((1 - LOSS) * shortest)) - Q + 1))
            self.ids.append(item_id)
            self.texts.append(flat)
            self.starts.append(starts)
        self.longest = max(map(len, self.texts), default=0)
        self.least = np.array(least, dtype=np.int64)
        if self.ids:
            h, p, o = np.concatenate(hashes), np.concatenate(places), np.concatenate(owners)
            order = np.argsort(h, kind="stable")
            self.hashes, first, counts = np.unique(h[order], return_index=True, return_counts=True)
            self.first, self.counts, self.places, self.owners = first, counts, p[order], o[order]
            self.seen = np.zeros(1 << 20, dtype=bool)
            self.seen[(self.hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        else:
            self.hashes = np.empty(0, dtype=np.uint64)

    def words(self, item: int, a: int, b: int) -> int:
        """How many words of the item start in [a, b)."""
        starts = self.starts[item]
        return bisect_right(starts, b - 1) - bisect_right(starts, a - 1)

    def search(self, texts: Sequence[str | None]) -> list[list[tuple[int, int]]]:
        """For each text the (item id, words of its longest passage) that it leaks."""
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        chunk: list[tuple[int, str]] = []
        size = 0
        for i, text in enumerate(texts):
            if text and not text.isspace() and len(self.hashes):
                flat = compact(text)
                if len(flat) >= Q:
                    chunk.append((i, flat))
                    size += len(flat)
            if size >= CHUNK_CHARS or (i == len(texts) - 1 and chunk):
                self._search_chunk(chunk, out)
                chunk, size = [], 0
        return out

    def _search_chunk(self, chunk: list[tuple[int, str]], out: list[list[tuple[int, int]]]) -> None:
        joined = ("\0" * Q).join(flat for _, flat in chunk)
        begins = np.cumsum([0, *(len(flat) + Q for _, flat in chunk)])[:-1]
        doc, item, place = self._in_strong_bands(joined)
        if not len(doc):
            return
        owner = np.searchsorted(begins, doc, side="right") - 1
        order = np.lexsort((place, doc, item, owner))
        doc, item, place, owner = doc[order], item[order], place[order], owner[order]
        edges = np.concatenate([[0], np.nonzero(np.diff(owner))[0] + 1, [len(owner)]])
        for a, b in zip(edges, edges[1:]):
            n = int(owner[a])
            i, flat = chunk[n]
            out[i] = self._leaks(flat, doc[a:b] - begins[n], item[a:b], place[a:b])

    def _in_strong_bands(self, joined: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the text, item, place in the item) of the q-grams in bands of diagonals, overlapping by half, that hold Q of them, and in the bands next to these.

        The text is taken in slices; a slice looks as far over its edges as the q-grams of one band can lie apart, so the slices don't show in the result.
        """
        half, n_items = BAND // 2, len(self.ids)
        margin = self.longest + 4 * BAND
        step = max(20_000, min(CHUNK_CHARS, CELLS * half // n_items - 2 * margin))
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for start in range(0, len(joined), step):
            low = max(0, start - margin)
            h = qgram_hashes(_codes(joined[low : start + step + margin]))
            hits = np.nonzero(self.seen[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])[0]
            at = np.searchsorted(self.hashes, h[hits])
            at[at == len(self.hashes)] = 0
            right = self.hashes[at] == h[hits]
            hits, at = hits[right], at[right]
            if not len(hits):
                continue
            counts = self.counts[at]
            where = np.arange(int(counts.sum())) + np.repeat(self.first[at] - np.cumsum(counts) + counts, counts)
            doc, item, place = np.repeat(hits, counts), self.owners[where], self.places[where]
            band = (doc - place + self.longest) // half + 1
            width = (len(h) + self.longest) // half + 3
            cell = item * width + band
            count = np.bincount(cell, minlength=n_items * width)
            strong = np.nonzero(count)[0]
            strong = strong[count[strong] + np.maximum(count[strong - 1], count[strong + 1]) >= Q]
            near = np.zeros(n_items * width, dtype=bool)
            near[strong] = near[strong - 1] = near[strong + 1] = True
            keep = near[cell] & (doc + low >= start) & (doc + low < start + step)
            kept.append((doc[keep] + low, item[keep], place[keep]))
        if not kept:
            return (np.empty(0, dtype=np.int64),) * 3
        return tuple(np.concatenate(parts) for parts in zip(*kept))

    def _leaks(self, flat: str, doc: np.ndarray, item: np.ndarray, place: np.ndarray) -> list[tuple[int, int]]:
        """(item id, words) of the items of which the document holds a passage; places explained by a better item count no more.

        The hits come sorted by item and place. Hits of one item that are further apart than an interruption can't be in one passage, so they are
        searched apart; the better a passage, the earlier it takes its places, and a worse one that wanted some of them is searched again.
        """
        edges = np.nonzero((np.diff(item) != 0) | (np.diff(doc) > INTERRUPTION + Q))[0] + 1
        starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(doc)]])
        enough = ends - starts >= self.least[item[starts]]
        free = np.ones(len(flat), dtype=bool)
        queue: list[tuple] = []

        def offer(k: int, d: np.ndarray, p: np.ndarray) -> None:
            """Into the queue with the characters that the hits cover, which no passage of theirs can exceed."""
            if len(d) >= self.least[k]:
                heappush(queue, (-(Q + int(np.minimum(d[1:] - d[:-1], Q).sum())), 0, self.ids[k], int(d[0]), k, None, d, p))

        def best(least_score: float) -> tuple | None:
            """The best passage in the queue if it scores ``least_score`` or more, out of the queue; what only might be as good is aligned now."""
            while queue and -queue[0][0] >= least_score:
                top = heappop(queue)
                _, _, _, _, k, got, d, p = top
                if got is not None:
                    return top
                left = free[d] & free[d + Q - 1]
                if not left.all():
                    offer(k, d[left], p[left])
                elif got := self._chain(k, flat, d.tolist(), p.tolist()):
                    heappush(queue, (-got[0], -got[1], self.ids[k], got[2], k, got, d, p))
            return None

        for a, b in zip(starts[enough].tolist(), ends[enough].tolist()):
            offer(int(item[a]), doc[a:b], place[a:b])
        found: dict[int, int] = {}
        while (top := best(0)) is not None:
            _, _, _, _, k, (score, words, lo, hi, pieces), d, p = top
            left = free[d] & free[d + Q - 1]
            if left.all():
                # Others that explain these places as well: shared wording, unless the item is whole.
                aside, ties = [], 0
                while (other := best(0.97 * score)) is not None:
                    aside.append(other)
                    i, (_, n, a, b, taken) = other[4], other[5]
                    if i != k and a < hi and b > lo and all(free[x:y].all() for x, y in taken):
                        ties += 1
                        if n >= len(self.starts[i]) - 2:
                            found[i] = max(found.get(i, 0), n)
                for other in aside:
                    heappush(queue, other)
                if not ties or words >= len(self.starts[k]) - 2:
                    found[k] = max(found.get(k, 0), words)
                for a, b in pieces:
                    free[a:b] = False
                left = free[d] & free[d + Q - 1]
            offer(k, d[left], p[left])
        return sorted((self.ids[k], w) for k, w in found.items())

    def _chain(self, k: int, flat: str, doc: list[int], place: list[int]) -> tuple[int, int, int, int, tuple] | None:
        # Runs of q-grams on one diagonal become blocks.
        blocks: list[list[int]] = []
        open_on: dict[int, int] = {}
        for d, p in zip(doc, place):
            g = d - p
            j = open_on.get(g)
            if j is not None and d <= blocks[j][1] + 1:
                blocks[j][1] = max(blocks[j][1], d + Q - 1)
            else:
                open_on[g] = len(blocks)
                blocks.append([d, d + Q - 1, p])
        # Chain blocks in order on both sides; a gap costs its edits.
        n = len(blocks)
        text = self.texts[k]
        reach = INTERRUPTION + len(text)
        best = [b[1] - b[0] + 1 for b in blocks]
        edits = [0] * n
        prev = [-1] * n
        for j in range(n):
            d0, d1, p0 = blocks[j]
            own = d1 - d0 + 1
            for i in range(j - 1, -1, -1):
                e0, e1, q0 = blocks[i]
                if d0 - e0 > reach:
                    break
                q1 = q0 + e1 - e0
                if e0 >= d0 or q0 >= p0:
                    continue
                overlap = max(0, e1 - d0 + 1, q1 - p0 + 1)
                if overlap >= own or best[i] + own - overlap <= best[j]:
                    continue
                gap_doc, gap_item = d0 - e1 - 1, p0 - q1 - 1
                if gap_item > GAP or gap_doc > INTERRUPTION:
                    continue
                # A gap costs an edit at least, and one for each character it lacks.
                if best[i] + own - overlap - max(gap_item - max(gap_doc, 0), gap_item > 0 or gap_doc > 0) <= best[j]:
                    continue
                cost = _gap_edits(flat[e1 + 1 : d0], text[q1 + 1 : p0]) if gap_doc > 0 or gap_item > 0 else abs((d0 - p0) - (e0 - q0))
                score = best[i] + own - overlap - cost
                if score > best[j]:
                    best[j], prev[j], edits[j] = score, i, edits[i] + min(cost, max(gap_item, 0) + Q)
        # All chain ends in order of score, as far as the first that passes and its equals.
        matched, first = [0] * n, list(range(n))
        for j in range(n):
            i = prev[j]
            matched[j] = blocks[j][1] - blocks[j][0] + 1 + (matched[i] if i >= 0 else 0)
            if i >= 0:
                first[j] = first[i]
        found = None
        for j in sorted(range(n), key=lambda j: -best[j]):
            if found and best[j] < found[0]:
                break
            a, b = blocks[first[j]][2], blocks[j][2] + blocks[j][1] - blocks[j][0] + 1
            if matched[j] < (1 - EDIT_SHARE) * 0.6 * (b - a) or edits[j] > EDIT_SHARE * (b - a):
                continue
            words = self.words(k, max(0, a - 1), b)
            if words >= MIN_WORDS or words >= len(self.starts[k]) and matched[j] >= 0.8 * len(text):
                i = j
                pieces: list[tuple[int, int]] = []
                while i >= 0:
                    d0, d1, _ = blocks[i]
                    if pieces and pieces[-1][0] - d1 <= GAP:
                        pieces[-1] = (d0, pieces[-1][1])
                    else:
                        pieces.append((d0, d1 + 1))
                    i = prev[i]
                got = (best[j], words, blocks[first[j]][0], blocks[j][1] + 1, tuple(pieces))
                found = got if found is None or got > found else found
        return found


def _gap_edits(a: str, b: str) -> int:
    """Edits between the two sides of a gap, whose anchors keep the alignment in a band; text put in between costs no more than one word."""
    if not a or not b:
        return len(b) if not a else min(len(a), Q) if len(a) <= GAP else 2 * Q
    if len(a) > 2 * len(b) + 2 * Q:
        return len(b) + (Q // 2 if len(a) <= GAP else 2 * Q)
    return edit_distance(a, b)


def edit_distance(a: str, b: str) -> int:
    """Edits between two strings; a column of the alignment is held in the bits of two integers."""
    if a == b:
        return 0
    at: dict[str, int] = {}
    for i, c in enumerate(b):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(b)) - 1
    last, edits, up, down = 1 << (len(b) - 1), len(b), full, 0
    for c in a:
        equal = at.get(c, 0)
        across = (((equal & up) + up) ^ up) | equal
        more, fewer = (down | ~(across | up)) & full, up & across
        edits += (more & last != 0) - (fewer & last != 0)
        more, fewer = more << 1 | 1, fewer << 1
        up, down = (fewer | ~(equal | down | more)) & full, more & (equal | down) & full
    return edits


_LEAKS = T.ArrayType(T.StructType([T.StructField("item", T.LongType()), T.StructField("words", T.IntegerType())]))


def find_leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "item_text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(``doc_key``, ``item_key``, words): documents that hold an item or a passage of it, with the words of the passage.

    Null, empty and blank documents leak nothing; null items and items of fewer than Q letters are never leaked. Items are
    taken in blocks of at most ``block_chars`` characters (their number is fixed by what is held out,
    not by the corpus), each indexed, broadcast and held against all documents; there is no shuffle of
    texts. Other columns are not read.
    """
    spark = docs.sparkSession
    known = items.select(F.col(f"`{item_key}`").cast("long").alias("i"), F.col(f"`{item_text}`").cast("string").alias("t")).filter(F.col("t").isNotNull()).dropDuplicates()
    total = known.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // block_chars))
    rows = docs.select(F.col(f"`{doc_key}`").alias("d"), F.col(f"`{text}`").cast("string").alias("t")).filter(F.col("t").isNotNull())
    out = None
    for b in range(blocks):
        part = known.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b) if blocks > 1 else known
        shared = spark.sparkContext.broadcast(sorted((r["i"], r["t"]) for r in part.collect()))
        got = rows.select("d", F.explode(_searcher(shared)("t")).alias("l")).select(F.col("d").alias(doc_key), F.col("l.item").alias(item_key), F.col("l.words").alias("words"))
        out = got if out is None else out.unionByName(got)
    return out.groupBy(doc_key, item_key).agg(F.max("words").alias("words"))


def _searcher(shared):
    @F.pandas_udf(_LEAKS)
    def search(texts: pd.Series) -> pd.Series:
        items = shared.value
        key = hash(tuple(items))
        if key not in _INDEXES:
            _INDEXES.clear()
            _INDEXES[key] = ItemIndex(items)
        return pd.Series([[{"item": i, "words": w} for i, w in got] for got in _INDEXES[key].search([t if isinstance(t, str) else None for t in texts])], dtype=object)

    return search


_INDEXES: dict[int, ItemIndex] = {}
