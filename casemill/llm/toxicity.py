"""Abusive, hateful or sexually explicit language: a calibrated score for every document and rates per source.

A document is cut into sentences, and each sentence is brought into a form in which disguises no longer
count (look-alike letters, digits for letters, dots or stars in words, stretched letters, slips in
telling words). Two lexicons give densities: a short general one by kind, and one learnt from the
ratings, whose words and word pairs carry the log-odds of a document that holds them being rated
abusive. Every sentence counts, with or without a hit: evidence, densities, words of address nearby,
capitals, punctuation and disguises of the most telling sentence and of the whole document are the
dense features. Gradient-boosted trees are fitted to the ratings, and isotonic regression on held-out
folds turns their sums into probabilities; a fold's documents are never described by a lexicon that
was learnt from their own ratings. The model is fitted on at most MAX_RATED rated documents; every
document is scored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casemill.llm.chars import ACCENT, HIDDEN
from casemill.session import cut

#: The model is fitted on at most this many rated documents, chosen by the hash of their id.
MAX_RATED = 20_000
#: The learnt lexicon holds at most this many words and pairs, the most telling ones, each seen in at least LEAST_DOCS rated documents.
MAX_TERMS, LEAST_DOCS = 40_000, 3
FOLDS = 5
THRESHOLD = 0.5

# General words and pairs by kind in English, German, French, Spanish and Japanese, without accents.
LEXICONS = {
    "insult": """idiot|idiots|moron|morons|imbecile|cretin|halfwit|dumbass|asshole|assholes|arsehole|bastard|bastards|bitch|bitches|prick|dickhead|shithead|scum|scumbag|vermin|worthless|loser|losers|
clown|braindead|parasite|twat|wanker|cunt|retard|retarded|dimwit|nitwit|pathetic|stupid|fool|jerk|freak|ugly|liar|coward|disgusting|filthy|garbage|trash|shut up|fuck off|fuck you|screw you|
vollidiot|idioten|arschloch|drecksack|wichser|hurensohn|missgeburt|abschaum|trottel|depp|schwachkopf|scheisskerl|dummkopf|connard|connards|connasse|ordure|minable|encule|debile|ta gueule|salaud|abruti|
imbecil|basura|gilipollas|cabron|idiota|estupido|pendejo|escoria|callate|バカ|馬鹿|クズ|野郎|アホ|黙れ|ゴミ|うざい|きもい""",
    "threat": """kill you|beat you|hurt you|shoot you|stab you|find you|watch your|smash|strangle|murder you|break your|cut your|slit your|burn your|umbringen|mach dich|te tuer|te casser|te retrouver|matarte|te matare|romperte|殺す|殺してやる|ぶっ殺|覚えてろ""",
    "selfharm": """kill yourself|hang yourself|end yourself|drop dead|die already|off dead|hope you|kys|verreck|verrecken|stirb|creve|crevez|pends toi|tue toi|matate|muerete|死ね|消えろ|自殺しろ|首を吊""",
    "group": """subhuman|subhumans|savages|exterminate|gas them|deport them|wipe them|like rats|like animals|go back|their kind|inferior|untermenschen|ungeziefer|abschieben|vergasen|vermine|ratas|害虫|追い出せ|劣等""",
    "sexual": """tits|horny|naked|nude|nudes|slut|sluts|whore|whores|dick|cock|pussy|blowjob|orgasm|cum|boobs|fuck me|sexy|porn|xxx|undress|rape you|raped|schlampe|ficken|fotze|titten|geil|hure|
sucer|pute|salope|baiser|follar|follarte|zorra|puta|desnudate|tetas|淫乱|裸|おっぱい|セックス|エロ""",
    "swear": """damn|hell|crap|shit|fuck|fucking|bullshit|merde|mierda|scheisse|putain|joder|くそ|bloody""",
}
ADDRESS = "you|your|yours|yourself|u|ur|ye|du|dich|dir|dein|deine|deinen|ihr|euch|tu|te|toi|ton|ta|vous|votre|ti|tus|eres|sois".split("|")
ADDRESS_JA = ("お前", "おまえ", "貴様", "てめえ", "あんた")
KINDS = tuple(LEXICONS)
_HOMOGLYPH = str.maketrans(dict(zip("аеорсухіјѕԁһӏмткнвгпοιαρτυκνηε", "aeopcyxijsdhlmtkhbrnoiaptuknne")))
_LEET = str.maketrans("0134579@$!€", "oieastgasie")
_LEETISH = re.compile(r"[a-z@$€][013457@$!€]+[a-z]|(?<![\w.,])[013457@$€]+[a-z]{3}|[a-z]{2}[013457@$€]+(?!\w)")
_LEET_WORD = re.compile(r"[a-z0134579@$!€]+")
_UNIT = re.compile(r"\d+[a-z]{1,3}|[a-z]{1,3}\d+")
_SPACED = re.compile(r"\b(?:[a-z][.\-_*]){2,}[a-z]\b|(?<![\w'’])(?:[a-z] ){3,}[a-z](?![\w'’])")
_STARS = re.compile(r"\b[a-z]\*{2,}[a-z]?|\b[a-z]+\*+[a-z]+")
_STRETCH = re.compile(r"([^\W\d_])\1{2,}")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|[\n\r]+|\s+…\s+")
_TOKEN = re.compile(r"[^\W_]+")
_ALIKE = re.compile("[ıͰ-ԯ]")
_LATIN_LETTER, _BETWEEN = re.compile("[a-z]"), re.compile(r"[.\-_* ]")
_JA = re.compile(r"[぀-ヿ一-鿿]")
#: The word that stands for one with stars in it, and the one that stands for a number.
STARRED, NUMBER = "starredword", "0"
FEATURES = (
    "net_max", "net_second", "net_mean", "found_max", "top_max", "second_top", "strong_max", "against_top", "density_top", "telling_sentences",
    *(f"{k}_max" for k in KINDS), "lexicon_max", "lexicon_doc", "lexicon_density_max", "lexicon_near",
    "address_top", "address_doc", "address_near_top", "caps_top", "caps_sentences", "exclaim_top", "exclaim_doc",
    "leet_top", "leet_doc", "stars_top", "stars_doc", "spaced_doc", "mixed_doc", "stretch_doc", "fixed_top", "length_top", "log_length",
)


def _plain(text: str) -> str:
    return text if text.isascii() else HIDDEN.sub("", unicodedata.normalize("NFKC", text))


def _bare(text: str) -> str:
    """Without accents."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", ACCENT.sub("", unicodedata.normalize("NFD", text))).replace("ß", "ss")


def general_lexicon() -> tuple[dict[str, int], dict[str, int]]:
    """(words and pairs, Japanese entries) with the index of their kind."""
    latin, japanese = {}, {}
    for i, entries in enumerate(LEXICONS.values()):
        for e in entries.replace("\n", "").split("|"):
            e = unicodedata.normalize("NFC", _bare(e.strip()))
            (japanese if _JA.search(e) else latin).setdefault(e, i)
    return latin, japanese


@dataclass(slots=True)
class Sentence:
    """A sentence as stored, its words without disguise, and how many disguises of each kind were undone."""

    raw: str
    words: list[str]
    leet: int = 0
    stars: int = 0
    spaced: int = 0
    mixed: int = 0
    stretch: int = 0


def sentences(text: str | None) -> Iterator[Sentence]:
    """The sentences of a text; none for null, empty and blank texts."""
    if not text or text.isspace():
        return
    plain = _plain(text)
    whole = plain.lower()
    ascii_only, starred = whole.isascii(), "*" in whole
    if not ascii_only:
        # What hides behind look-alikes and accents is looked for in the undisguised text.
        whole = _bare(whole.casefold().translate(_HOMOGLYPH) if _ALIKE.search(whole) else whole)
    spaced, leetish, stretched, japanese = _SPACED.search(whole), _LEETISH.search(whole), _STRETCH.search(whole), not ascii_only and _JA.search(whole)
    for raw in _SENTENCE.split(plain):
        if not raw or raw.isspace():
            continue
        low = raw.lower()
        s = Sentence(raw, [])
        if not ascii_only and not low.isascii():
            low = low.casefold()
            if _ALIKE.search(low) and _LATIN_LETTER.search(low):
                swapped = low.translate(_HOMOGLYPH)
                s.mixed = sum(a != b for a, b in zip(low, swapped))
                low = swapped
            low = _bare(low)
        if starred:
            low, s.stars = _STARS.subn(f" {STARRED} ", low)
        if spaced:
            for w in _SPACED.findall(low):
                s.spaced += 1
                low = low.replace(w, _BETWEEN.sub("", w))
        if leetish and _LEETISH.search(low):
            low, s.leet = _unleeted(low)
        if stretched:
            low, s.stretch = _STRETCH.subn(r"\1", low)
        words = _TOKEN.findall(low)
        if japanese:
            words = [p for w in words for p in (_pieces(w) if _JA.search(w) else (w,))]
        s.words = [NUMBER if w[0] <= "9" and w.isdigit() else w for w in words]
        yield s


def _pieces(run: str) -> list[str]:
    """Overlapping threes of a run of characters without blanks."""
    return [run[i : i + 3] for i in range(max(1, len(run) - 2))]


def _unleeted(low: str) -> tuple[str, int]:
    count = 0

    def word(m: re.Match) -> str:
        nonlocal count
        whole = m[0]
        core = whole.rstrip("!")
        if core.isalpha() or core.isdigit() or _UNIT.fullmatch(core) or not any(c.isalpha() for c in core):
            return whole
        count += 1
        return core.translate(_LEET) + whole[len(core) :]

    return _LEET_WORD.sub(word, low), count


def terms(text: str | None) -> set[str]:
    """The distinct words and word pairs of all sentences of a text."""
    out: set[str] = set()
    for s in sentences(text):
        out.update(s.words)
        out.update(map(" ".join, zip(s.words, s.words[1:])))
    return out


def log_odds(abusive: float, other: float, all_abusive: float, all_other: float, z: float = 1.3) -> float:
    """The log-odds that a term speaks for abuse, drawn towards 0 by ``z`` standard errors."""
    value = math.log((abusive + 0.5) / (all_abusive + 1.0)) - math.log((other + 0.5) / (all_other + 1.0))
    slack = z * math.sqrt(1 / (abusive + 0.5) + 1 / (other + 0.5))
    return max(0.0, value - slack) if value > 0 else min(0.0, value + slack)


def slips(word: str) -> set[str]:
    """A word with two neighbours swapped or one inner letter dropped."""
    swaps = {word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)}
    drops = {word[:i] + word[i + 1 :] for i in range(1, len(word))}
    return (swaps | drops) - {word}


_LATIN, _JAPANESE = general_lexicon()
_ADDRESS = frozenset(ADDRESS)


def slip_table(weights: Mapping[str, float]) -> dict[str, str]:
    """Slips of telling and of general words of five letters or more, each with its word; a slip of several stands for the most telling."""
    telling = {t for t, w in weights.items() if w > 1.0 and " " not in t and t.isascii() and t.isalpha() and len(t) >= 5}
    telling |= {t for t in _LATIN if " " not in t and len(t) >= 5}
    made: dict[str, str] = {}
    for word in sorted(telling, key=lambda t: (-weights.get(t, 0.0), t)):
        for s in slips(word) - telling:
            made.setdefault(s, word)
    return made


class Lexicon:
    """Weights of learnt terms and kinds of general ones in one table, and the slips of telling words."""

    def __init__(self, weights: Mapping[str, float], fix: Mapping[str, str]):
        self.table: dict[str, tuple[float, int]] = {t: (w, _LATIN.get(t, -1)) for t, w in weights.items() if w}
        for t, k in _LATIN.items():
            self.table.setdefault(t, (0.0, k))
        self.fix = dict(fix)

    def features(self, text: str | None) -> list[float] | None:
        """The dense features of a document in the order of FEATURES; None for null, empty and blank texts."""
        get, fix, fixable = self.table.get, self.fix, self.fix.keys()
        nets: list[float] = []
        found_max = top_max = strong_max = lex_max = lex_doc = lex_density = lex_near = 0.0
        kinds_max = [0] * len(KINDS)
        best, top = -math.inf, None
        address_doc = exclaim_doc = leet = stars = spaced = mixed = stretch = caps_sentences = n_words = 0
        for s in sentences(text):
            words = s.words
            n_words += len(words)
            fixed = 0
            if not fixable.isdisjoint(words):
                fixed = sum(w in fix for w in words)
                words = [fix.get(w, w) for w in words]
            address = [] if _ADDRESS.isdisjoint(words) else [i for i, w in enumerate(words) if w in _ADDRESS]
            found = against = highest = 0.0
            strong, hits, at, kinds = 0, [], -1, None
            told = [(i, got) for i, w in enumerate(words) if (got := get(w))]
            told += [(i, got) for i, pair in enumerate(map(" ".join, zip(words, words[1:])), 1) if (got := get(pair))]
            for i, (weight, kind) in told:
                if weight > 0:
                    found += weight
                    strong += weight > 1.5
                    if weight > highest:
                        highest, at = weight, i
                else:
                    against += weight
                if kind >= 0:
                    kinds = kinds or [0] * len(KINDS)
                    kinds[kind] += 1
                    hits.append((i, kind))
            raw = s.raw
            japanese = False
            if not raw.isascii() and _JA.search(raw):
                japanese = any(a in raw for a in ADDRESS_JA)
                for entry, kind in _JAPANESE.items():
                    if entry in raw:
                        kinds = kinds or [0] * len(KINDS)
                        kinds[kind] += 1
                        hits.append((0, kind))
            lexicon = sum(k != SWEAR for _, k in hits)
            net = found + 0.5 * against + 2.0 * lexicon + 2.0 * s.stars
            nets.append(net)
            address_doc += len(address) + japanese
            exclaim = raw.count("!")
            exclaim_doc += exclaim
            leet += s.leet
            stars += s.stars
            spaced += s.spaced
            mixed += s.mixed
            stretch += s.stretch
            shouted = raw.isupper() and len(words) >= 3
            caps_sentences += shouted
            found_max, top_max, strong_max = max(found_max, found), max(top_max, highest), max(strong_max, strong)
            if hits:
                near = japanese or sum(any(abs(i - a) <= 6 for a in address) for i, k in hits if k != SWEAR)
                lex_max, lex_near, lex_doc = max(lex_max, lexicon), max(lex_near, near), lex_doc + lexicon
                lex_density = max(lex_density, lexicon / max(3, len(words)))
                kinds_max = [max(a, b) for a, b in zip(kinds_max, kinds)]
            if net > best:
                best = net
                top = (against, found / max(3, len(words)), len(address) + japanese, float(at >= 0 and (japanese or any(abs(at - a) <= 6 for a in address))), raw, exclaim, s.leet, s.stars, fixed, len(words), highest)
        if top is None:
            return None
        against, density, address, near_top, raw, exclaim, leet_top, stars_top, fixed, length, highest = top
        letters = sum(map(str.isalpha, raw))
        nets.sort(reverse=True)
        return [
            nets[0], nets[1] if len(nets) > 1 else 0.0, sum(nets) / len(nets), found_max, top_max, highest, float(strong_max), against, density, float(sum(x > 4.0 for x in nets)),
            *map(float, kinds_max), float(lex_max), float(lex_doc), lex_density, float(lex_near),
            float(address), address_doc / max(1, n_words), near_top, sum(map(str.isupper, raw)) / max(1, letters), float(caps_sentences), float(exclaim), exclaim_doc / len(nets),
            float(leet_top), float(leet), float(stars_top), float(stars), float(spaced), float(mixed), float(stretch), float(fixed), float(length), math.log1p(n_words),
        ]


SWEAR = KINDS.index("swear")


@dataclass
class Trees:
    """Gradient-boosted regression trees for the logistic loss on binned features, one histogram of all features per node."""

    rounds: int = 80
    depth: int = 3
    rate: float = 0.12
    least: int = 8
    bins: int = 24
    shrink: float = 2.0
    base: float = 0.0
    trees: list = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
        cuts = [np.unique(np.quantile(x[:, j], np.concatenate([np.linspace(0, 0.9, self.bins // 2 + 1)[1:], 1 - np.geomspace(0.09, 0.002, self.bins // 2)]))) for j in range(x.shape[1])]
        cuts = [np.unique(np.concatenate([c, np.unique(x[:, j])[:-1][:6]])) for j, c in enumerate(cuts)]
        width = max(map(len, cuts)) + 1
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
        flat = binned + np.arange(x.shape[1]) * width
        p = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            grad, hess = weight * (y - p), weight * np.maximum(p * (1 - p), 1e-6)
            step = np.empty(len(y))
            everything = np.arange(len(y))
            tree = self._grow(flat, cuts, width, grad, hess, everything, self._sums(flat, width, grad, hess, everything), self.depth, step)
            self.trees.append(tree)
            score += self.rate * step
        return self

    def _sums(self, flat, width, grad, hess, rows):
        cells, n = flat[rows].ravel(), flat.shape[1]
        many = lambda v: np.bincount(cells, weights=v, minlength=n * width).reshape(n, width)
        return np.stack([many(np.repeat(grad[rows], n)), many(np.repeat(hess[rows], n)), many(None)])

    def _grow(self, flat, cuts, width, grad, hess, rows, sums, depth, step):
        g, h, n = sums[0, 0].sum(), sums[1, 0].sum(), len(rows)
        value = float(g / (h + self.shrink))
        step[rows] = value
        if depth == 0 or n < 2 * self.least:
            return ("leaf", value)
        gs, hs, ns = sums.cumsum(axis=2)
        gain = gs**2 / (hs + self.shrink) + (g - gs) ** 2 / (h - hs + self.shrink) - g**2 / (h + self.shrink)
        gain[(ns < self.least) | (n - ns < self.least)] = -1
        for j, c in enumerate(cuts):
            gain[j, len(c) :] = -1
        j, k = np.unravel_index(int(np.argmax(gain)), gain.shape)
        if gain[j, k] <= 1e-6:
            return ("leaf", value)
        low = flat[rows, j] <= k + j * width
        left, right = rows[low], rows[~low]
        # The larger side's histogram is what the smaller one leaves.
        small = self._sums(flat, width, grad, hess, left if len(left) <= len(right) else right) if depth > 1 else None
        sums_left = sums_right = None
        if small is not None:
            sums_left, sums_right = (small, sums - small) if len(left) <= len(right) else (sums - small, small)
        else:
            sums_left, sums_right = (np.array([[[grad[r].sum()]], [[hess[r].sum()]], [[float(len(r))]]]) for r in (left, right))
        return ("split", int(j), float(cuts[j][k]), self._grow(flat, cuts, width, grad, hess, left, sums_left, depth - 1, step), self._grow(flat, cuts, width, grad, hess, right, sums_right, depth - 1, step))

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += self.rate * _apply(tree, x)
        return out


def _apply(tree, x: np.ndarray) -> np.ndarray:
    if tree[0] == "leaf":
        return np.full(len(x), tree[1])
    _, j, edge, left, right = tree
    goes = x[:, j] <= edge
    out = np.empty(len(x))
    out[goes] = _apply(left, x[goes])
    out[~goes] = _apply(right, x[~goes])
    return out


def isotonic(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: breakpoints and non-decreasing values."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []
    for r, v, w in zip(raw[order], y[order], weight[order]):
        blocks.append([v * w, w, r, r])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, w2, _, hi = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += w2
            blocks[-1][3] = hi
    xs, ys = [], []
    for s, w, lo, hi in blocks:
        xs += [lo, hi] if hi > lo else [lo]
        ys += [s / w] * (2 if hi > lo else 1)
    return np.array(xs), np.array(ys)


@dataclass
class Model:
    """A lexicon, trees and their calibration; ``held`` are the trees' sums for held-out folds in the order of the ratings."""

    lexicon: Lexicon
    trees: Trees
    xs: np.ndarray
    ys: np.ndarray
    held: np.ndarray | None = None

    def score(self, texts: Iterable[str | None]) -> np.ndarray:
        rows = [self.lexicon.features(t) for t in texts]
        out = np.zeros(len(rows))
        there = [i for i, r in enumerate(rows) if r is not None]
        if there:
            out[there] = np.interp(self.trees.raw(np.array([rows[i] for i in there], dtype=float)), self.xs, self.ys)
        return out


def fit(lexicon: Lexicon, x: np.ndarray, y: np.ndarray, weight: np.ndarray, fold: np.ndarray) -> Model:
    """The trees on all rated documents, calibrated on predictions for held-out folds. ``y`` is the share of raters who saw abuse."""
    if len(y) < 4 * FOLDS or not 0 < np.average(y, weights=weight) < 1 or any((fold == f).all() for f in range(FOLDS)):
        rate = float(np.average(y, weights=weight)) if len(y) else 0.0
        return Model(lexicon, Trees(base=0.0), np.array([0.0, 1.0]), np.array([rate, rate]))
    held = np.empty(len(y))
    for f in np.unique(fold):
        held[fold == f] = Trees().fit(x[fold != f], y[fold != f], weight[fold != f]).raw(x[fold == f])
    xs, ys = isotonic(held, y, weight)
    return Model(lexicon, Trees().fit(x, y, weight), xs, ys, held)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _term_column(texts: pd.Series) -> pd.Series:
    return pd.Series([sorted(terms(t if isinstance(t, str) else None)) for t in texts], dtype=object)


def learn_lexicon(sample: DataFrame) -> tuple[Lexicon, list[Lexicon]]:
    """The lexicon of all rated documents and, for each fold, one learnt from the other folds.

    ``sample`` has text, y (share of raters who saw abuse), w (ratings) and fold. Terms are counted in
    Spark, aggregated within tasks first; only the most telling MAX_TERMS reach the driver.
    """
    of = lambda k, share: F.sum(F.when(F.col("fold") == k, share))
    abusive, other = F.col("y") * F.col("w"), (1 - F.col("y")) * F.col("w")
    totals = sample.agg(*[F.coalesce(of(k, s), F.lit(0.0)).alias(f"{n}{k}") for k in range(FOLDS) for n, s in (("p", abusive), ("n", other))]).first()
    all_p, all_n = sum(totals[f"p{k}"] for k in range(FOLDS)), sum(totals[f"n{k}"] for k in range(FOLDS))
    counted = (
        sample.select("fold", abusive.alias("p"), other.alias("n"), F.explode(_term_column("text")).alias("term"))
        .groupBy("term").agg(F.count(F.lit(1)).alias("docs"), *[F.coalesce(of(k, F.col(s)), F.lit(0.0)).alias(f"{s}{k}") for k in range(FOLDS) for s in ("p", "n")])
        .filter(F.col("docs") >= LEAST_DOCS)
    )
    p, n = sum((F.col(f"p{k}") for k in range(1, FOLDS)), F.col("p0")), sum((F.col(f"n{k}") for k in range(1, FOLDS)), F.col("n0"))
    lean = F.log((p + 0.5) / F.lit(all_p + 1.0)) - F.log((n + 0.5) / F.lit(all_n + 1.0))
    counts = cut(counted.withColumn("lean", F.abs(lean) - 1.3 * F.sqrt(1 / (p + 0.5) + 1 / (n + 0.5))).withColumn("side", F.signum(lean)))
    rows = counts.filter("lean > 0.1").orderBy(F.desc("lean"), "term").limit(MAX_TERMS).collect()

    def weights(left_out: int | None) -> dict[str, float]:
        kept = [k for k in range(FOLDS) if k != left_out]
        tp, tn = sum(totals[f"p{k}"] for k in kept), sum(totals[f"n{k}"] for k in kept)
        return {r["term"]: log_odds(sum(r[f"p{k}"] for k in kept), sum(r[f"n{k}"] for k in kept), tp, tn) for r in rows}

    whole = weights(None)
    made = slip_table(whole)
    spark = sample.sparkSession
    # A slip that is a word of its own stays as it is.
    own = {r["term"] for r in counts.join(F.broadcast(spark.createDataFrame([(s,) for s in made], "term string")), "term").filter("side <= 0 or docs >= 20").select("term").collect()} if made else set()
    fix = {s: w for s, w in made.items() if s not in own}
    return Lexicon(whole, fix), [Lexicon(weights(k), fix) for k in range(FOLDS)]


def rated_sample(docs: DataFrame, ratings: DataFrame, max_rated: int = MAX_RATED) -> DataFrame:
    """(doc_id, text, y, w, fold) of the rated documents. Skipped ratings don't count; several ratings of a document are averaged.

    The ids are joined before any text is looked at, so only the sample goes through Python.
    """
    rated = ratings.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg("toxic").alias("y"), F.count("toxic").cast("double").alias("w"))
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rated)
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(FOLDS)).cast("int"))
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return cut(joined.filter(F.col("text").isNotNull()).repartition(cores, "doc_id"))


def train(docs: DataFrame, ratings: DataFrame, max_rated: int = MAX_RATED) -> Model:
    """A model from ratings (doc_id, toxic). Without ratings every score is 0."""
    sample = rated_sample(docs, ratings, max_rated)
    whole, by_fold = learn_lexicon(sample)
    shared = docs.sparkSession.sparkContext.broadcast(by_fold)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def described(texts: pd.Series, folds: pd.Series) -> pd.Series:
        return pd.Series([shared.value[f].features(t if isinstance(t, str) else None) for t, f in zip(texts, folds)], dtype=object)

    rows = [r for r in sample.select("doc_id", "y", "w", "fold", described("text", "fold").alias("x")).collect() if r["x"] is not None]
    rows.sort(key=lambda r: r["doc_id"])
    x = np.array([r["x"] for r in rows], dtype=float).reshape(len(rows), len(FEATURES))
    column = lambda name: np.array([r[name] for r in rows], dtype=float)
    return fit(whole, x, column("y"), column("w"), column("fold").astype(int))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1); null, empty and blank texts score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(t if isinstance(t, str) else None for t in texts))

    return docs.withColumn("score", scored(F.col(f"`{text}`").cast("string")))


def rates(scored: DataFrame, source: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """(source, docs, flagged, rate) per source; spellings that differ in case, blanks and marks are one source, null stays null."""
    name = F.nullif(F.regexp_replace(F.lower(F.trim(F.col(f"`{source}`"))), r"[\s\-]+", "_"), F.lit(""))
    return scored.groupBy(name.alias("source")).agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("score") >= threshold).alias("flagged"), F.avg((F.col("score") >= threshold).cast("double")).alias("rate"))
