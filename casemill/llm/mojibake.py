"""Garbled text from a wrong character encoding: found and restored by a table of garbled forms.

From all texts the distinct tokens with non-ASCII characters are taken, and from these the words and
parts of words that are clean. Each clean one is garbled under every chain of encodings; the result is
a table garbled form -> original. Document tokens (and their parts) are hash-joined against this
table. A match counts when the original is verified: it is clean, the form is not, and for forms that
could also be rightly stored words the original is much more common in the corpus. What is counted are
distinct texts, so copies and hot groups don't outweigh the original; rows count only where the original
stands in no fewer texts than the form. Only distinct tokens are joined.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casemill.llm.splits import hot_join
from casemill.session import cut

#: Encodings in which bytes were written and, for each, those in which they were read. Fixed values.
CHAINS = {
    "utf-8": ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp1253", "cp1254", "iso8859_2", "iso8859_15", "koi8_r", "cp866", "cp932", "euc_jp", "gbk", "big5", "cp949", "ascii"),
    "cp1252": ("utf-8", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp932", "ascii"),
    "latin-1": ("utf-8",),
    "mac_roman": ("cp1252", "utf-8"),
    "cp437": ("cp1252",),
    "cp850": ("cp1252",),
    "cp932": ("cp1252", "latin-1", "mac_roman", "utf-8", "euc_jp"),
    "euc_jp": ("cp1252", "latin-1", "cp932", "utf-8"),
}
#: Readings that are often applied twice.
TWICE = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850")
#: How much more common an original must be than a form that could be a word of its own.
RATIO, RATIO_SHORT = 3, 20
#: The longest form of one character: four bytes in UTF-8, each of them up to three bytes twice more. Longer forms than that are looked up as
#: words and whole tokens; a garbled run that is part of a longer token is told by the forms of its characters.
LONGEST = 4 * 3 * 3
#: Units longer than this are not garbled as a whole: their words, runs and characters are, which cover them.
UNIT, LOOKUP = 64, 64 * LONGEST
#: What replaces garbled tokens is broadcast up to this many characters, and joined by a shuffle beyond.
BROADCAST_CHARS = 20_000_000
_RUN = re.compile(r"[^\x00-\x7f]+")
_WORD = re.compile(r"(?:[^\W\d_]|[^\x00-\x7f])+(?:['’\-–](?:[^\W\d_]|[^\x00-\x7f])+)*")
_CJK = re.compile("[぀-ヿ一-鿿]")
_C1 = re.compile("[\x80-\x9f�]")
_EDGE = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
SPACE = "[ \\t\\n\\r]+"


def _read(data: bytes, enc: str) -> set[str]:
    """What the bytes look like when read as ``enc``: undefined bytes as U+FFFD, as controls, or dropped with a blank in place of a no-break space."""
    out = {data.decode(enc, "replace")}
    if enc.startswith(("cp125", "mac", "cp4", "cp8", "iso", "latin")):
        out.add("".join(_control(bytes([b]), enc) for b in data))
    return out


def _control(byte: bytes, enc: str) -> str:
    try:
        return byte.decode(enc)
    except UnicodeDecodeError:
        return byte.decode("latin-1")


def _bytes(text: str, enc: str) -> list[bytes | str]:
    """The text's bytes; characters that the encoding lacks stay as they are, as pieces between the bytes."""
    try:
        return [text.encode(enc)]
    except UnicodeEncodeError:
        pieces: list[bytes | str] = []
        for ch in text:
            try:
                b = ch.encode(enc)
                if pieces and isinstance(pieces[-1], bytes):
                    pieces[-1] += b
                else:
                    pieces.append(b)
            except UnicodeEncodeError:
                pieces.append(ch)
        return pieces


def garbled_forms(text: str) -> Iterator[tuple[str, str]]:
    """(form, chain) of a clean text under every chain of encodings; forms equal to the text are left out."""
    seen = {text}
    for written, readers in CHAINS.items():
        pieces = _bytes(text, written)
        if not any(isinstance(p, bytes) and not p.isascii() for p in pieces):
            continue
        for reader in readers:
            if len(pieces) == 1:
                forms = _read(pieces[0], reader)
            else:
                forms = {"".join(p if isinstance(p, str) else p.decode(reader, "replace") for p in pieces)}
            for form in forms:
                chain = f"{written}>{reader}"
                if form not in seen:
                    seen.add(form)
                    yield form, chain
                if written == "utf-8" and reader in TWICE:
                    for again in TWICE:
                        for second in _read(form.encode("utf-8", "replace"), again):
                            if second not in seen:
                                seen.add(second)
                                yield second, f"{chain}>utf-8>{again}"
                                if again == reader == "cp1252" and len(text) <= 3:
                                    for third in _read(second.encode("utf-8", "replace"), again):
                                        if third not in seen:
                                            seen.add(third)
                                            yield third, f"{chain}>utf-8>{again}>utf-8>{again}"


@lru_cache(maxsize=100_000)
def is_clean(text: str) -> bool:
    """Whether a word shows no trace of a wrong encoding by itself: no U+FFFD, no controls, no bytes that are UTF-8 again."""
    if _C1.search(text):
        return False
    for reader in ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp932"):
        for run in _RUN.findall(text):
            try:
                if run.encode(reader).decode("utf-8") != run and len(run) > 1:
                    return False
            except UnicodeError:
                pass
    return True


def clean_units(token: str) -> set[str]:
    """Clean words and parts of words of a token: the token without outer marks, its words, its non-ASCII runs, alone, with the next character, and each character."""
    bare = token.strip(_EDGE)
    units = {bare, *(m[0] for m in _WORD.finditer(token))}
    for m in _RUN.finditer(token):
        units |= {m[0], *m[0]}
        if m.end() < len(token):
            units |= {token[m.start() : m.end() + 1], m[0][-1] + token[m.end()]}
    return {u for u in units if len(u) <= UNIT and not u.isascii() and is_clean(u)}


def lookup_units(token: str) -> set[str]:
    """Parts of a document token that are looked up: the token, without outer marks, its words, and what starts at a non-ASCII character."""
    bare = token.strip(_EDGE)
    units = {token, bare, *(m[0] for m in _WORD.finditer(token))}
    for m in _RUN.finditer(token):
        a, b = m.span()
        for end in range(a + 1, min(len(token), a + LONGEST) + 1):
            units.add(token[a:end])
        for start in range(a + 1, b):
            for end in range(start + 2, min(b, start + 6) + 1):
                units.add(token[start:end])
    return {u for u in units if len(u) <= LOOKUP and not u.isascii()}


def _strength(form: str, orig: str, token: str, ratio: float, chain: str) -> int:
    """2: the form alone is proof; 1: it needs another one in the same value; 0: it proves nothing. ``ratio``: how much more common the original is."""
    bare = token.strip(_EDGE)
    run = max((len(r) for r in _RUN.findall(form)), default=0)
    if chain.startswith("cp1252>cp932") and any(len(r) > 1 for r in _RUN.findall(orig)):
        return 0  # Latin letters next to each other outside ASCII are hardly a word that was read as Japanese
    if "�" in form:
        return 2
    if _C1.search(form):
        return 2
    if run >= 2 and chain.startswith("utf-8>") and not form.isascii():
        return 2
    whole = form in (token, bare) or form in _WORD.findall(token)
    letters = sum(c.isascii() and c.isalnum() for c in form)
    if run >= 2 and ratio >= RATIO:
        return 2 if len(form) >= 4 else int(whole)
    if run >= 2:  # as common as its original: only Japanese words read as Latin letters are odd enough
        return int(whole and chain.startswith(("cp932>", "euc_jp>")) and len(_CJK.findall(orig)) >= 2)
    if not whole:
        return 0
    if letters >= 3 and ratio >= RATIO:
        return 2
    if ratio >= RATIO_SHORT:
        return 2
    return 1 if ratio >= RATIO else 0


def _ratio(m: Mapping[str, int]) -> float:
    """How much more common the original is than the form: by distinct texts, and by rows where the texts don't speak for the form."""
    texts = m["d_orig"] / m["d_form"]
    return max(texts, m["n_orig"] / m["n_form"]) if texts >= 1 else texts


def _restored(token: str, found: Sequence[tuple[str, str, tuple[int, int]]]) -> str:
    """The token with forms put back, longest first, the more common original where there are several."""
    best: dict[str, tuple[tuple[int, int], str]] = {}
    for form, orig, n in found:
        if form not in best or n > best[form][0]:
            best[form] = (n, orig)
    out, i = [], 0
    forms = sorted(best, key=len, reverse=True)
    while i < len(token):
        for form in forms:
            if token.startswith(form, i) and (form != "�"):
                out.append(best[form][1])
                i += len(form)
                break
        else:
            out.append(token[i])
            i += 1
    return "".join(out)


_UNITS = T.ArrayType(T.StringType())
_FORMS = T.ArrayType(T.StructType([T.StructField("form", T.StringType()), T.StructField("chain", T.StringType())]))


@F.pandas_udf(_UNITS)
def _clean_units(tokens: pd.Series) -> pd.Series:
    return pd.Series([sorted(clean_units(t)) for t in tokens], dtype=object)


@F.pandas_udf(_UNITS)
def _lookup_units(tokens: pd.Series) -> pd.Series:
    return pd.Series([sorted(lookup_units(t)) for t in tokens], dtype=object)


@F.pandas_udf(_FORMS)
def _garbled(units: pd.Series) -> pd.Series:
    return pd.Series([[{"form": f, "chain": c} for f, c in garbled_forms(u) if not f.isascii()] for u in units], dtype=object)


@F.pandas_udf(T.StructType([T.StructField("strength", T.IntegerType()), T.StructField("chain", T.StringType()), T.StructField("restored", T.StringType())]))
def _judge(tokens: pd.Series, found: pd.Series) -> pd.DataFrame:
    rows = []
    for token, matches in zip(tokens, found):
        kept = [(m["form"], m["orig"], (m["d_orig"], m["n_orig"]), s, m["chain"]) for m in matches if (s := _strength(m["form"], m["orig"], token, _ratio(m), m["chain"]))]
        top = max(kept, key=lambda k: (k[3], len(k[0])), default=None)
        rows.append((top[3] if top else 0, top[4] if top else None, _restored(token, [k[:3] for k in kept]) if top else token))
    return pd.DataFrame(rows, columns=["strength", "chain", "restored"])


def _values(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").cast("string").alias("text")) for f in fields])
    narrow = df.select(F.col(f"`{key}`").alias("k"), F.explode(entries).alias("e")).select("k", "e.field", "e.text")
    return narrow.filter(F.col("text").rlike("[^\\x00-\\x7F]"))


def garbled_tokens(values: DataFrame) -> DataFrame:
    """(token, strength, chain, restored) of the distinct garbled tokens in ``values`` (column text)."""
    tokens = values.select(F.xxhash64("text").alias("text_id"), F.explode(F.array_distinct(F.split("text", SPACE))).alias("token")).filter(F.col("token").rlike("[^\\x00-\\x7F]"))
    # n counts rows, d distinct texts; both are aggregated within map tasks first.
    per_text = tokens.groupBy("token", "text_id").agg(F.count(F.lit(1)).alias("n"))
    # The vocabulary and its units are small in bytes but heavy per row, so they are spread over all cores by hand.
    cores = values.sparkSession.sparkContext.defaultParallelism
    vocabulary = cut(per_text.groupBy("token").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d")).repartition(2 * cores, F.xxhash64("token")))
    units = vocabulary.select(F.explode(_clean_units("token")).alias("orig"), "n", "d").groupBy("orig").agg(F.sum("n").alias("n_orig"), F.sum("d").alias("d_orig")).repartition(2 * cores, F.xxhash64("orig"))
    garbled = units.select("orig", "n_orig", "d_orig", F.length("orig").alias("length"), F.explode(_garbled("orig")).alias("g")).select(F.col("g.form").alias("form"), F.struct("orig", "n_orig", "d_orig", "g.chain").alias("o"), "n_orig", "d_orig", "length", "orig", "g.chain")
    # The most common original of a form, by rows and by distinct texts.
    forms = garbled.groupBy("form").agg(F.array_distinct(F.array(F.max_by("o", F.struct("n_orig", "length", "orig", "chain")), F.max_by("o", F.struct("d_orig", "length", "orig", "chain")))).alias("os"))
    parts = vocabulary.select("token", "n", "d", F.explode(_lookup_units("token")).alias("form"))
    # A short form may stand in a third of all tokens; such forms are joined by broadcast.
    parts = cut(parts)
    matched = cut(hot_join(parts, forms, "form", parts.count()).filter(F.col("os").isNotNull()))
    n_form = matched.groupBy("form").agg(F.sum("n").alias("n_form"), F.sum("d").alias("d_form"))
    full = hot_join(matched, n_form, "form", matched.count()).withColumn("o", F.explode("os"))
    per_token = full.groupBy("token").agg(F.collect_list(F.struct("form", "o.orig", "o.n_orig", "o.d_orig", "o.chain", "n_form", "d_form")).alias("found"))
    judged = per_token.withColumn("j", _judge("token", "found")).select("token", "j.strength", "j.chain", "j.restored")
    return cut(judged.filter("strength > 0"))


def find_garbled(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(``key``, field) of every value that holds garbled text, whether it can be restored or not.

    Null, empty and pure ASCII values are never found. Repeated rows give one result row. A weak sign
    counts only beside a second one of the same chain in the same value. Other columns are not read.
    """
    found = _garbled_values(_hits(_values(df, key, fields)))
    return found.select("k", "field").distinct().withColumnRenamed("k", key)


def _garbled_values(hits: DataFrame) -> DataFrame:
    """(k, field, text_id, subs) of the values that are garbled: a strong sign, or two weak ones of the same chain; with what replaces their tokens."""
    per_value = hits.groupBy("k", "field", "text_id").agg(F.max("strength").alias("top"), F.count(F.lit(1)).alias("signs"), F.countDistinct("chain").alias("chains"), F.collect_set(F.struct("token", "restored")).alias("subs"))
    return per_value.filter((F.col("top") >= 2) | ((F.col("signs") >= 2) & (F.col("chains") < F.col("signs")))).select("k", "field", "text_id", "subs")


def _hits(values: DataFrame) -> DataFrame:
    """(k, field, text_id, token, strength, chain, restored): the garbled tokens of each value, matched by hash join."""
    garbled = garbled_tokens(values)
    tokens = values.select("k", "field", F.xxhash64("text").alias("text_id"), F.explode(F.array_distinct(F.split("text", SPACE))).alias("token")).filter(F.col("token").rlike("[^\\x00-\\x7F]"))
    # A token may stand in a third of all rows; such tokens are joined by broadcast.
    return hot_join(tokens, garbled, "token", values.count()).filter(F.col("strength").isNotNull())


def restore_garbled(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(``key``, field, text, restored) of every garbled value; what can't be restored stays as it is.

    ``restored`` puts the verified originals in place of garbled tokens; blanks are kept.
    """
    values = _values(df, key, fields)
    garbled = cut(_garbled_values(_hits(values)))
    # Texts stay where they are while what replaces their tokens is small; only garbled ones are made distinct.
    chars = garbled.agg(F.coalesce(F.sum(F.aggregate("subs", F.lit(64), lambda n, s: n + F.length(s["token"]) + F.length(s["restored"]))), F.lit(0))).first()[0]
    side = F.broadcast(garbled) if chars <= BROADCAST_CHARS else garbled

    @F.pandas_udf("string")
    def put_back(texts: pd.Series, subs: pd.Series) -> pd.Series:
        out = []
        for text, pairs in zip(texts, subs):
            known = {p["token"]: p["restored"] for p in pairs}
            out.append("".join(known.get(t, t) for t in re.split("([ \t\n\r]+)", text)))
        return pd.Series(out)

    side = side.select(F.col("k").alias("_k"), F.col("field").alias("_field"), F.col("text_id").alias("_id"), "subs")
    same = F.col("k").eqNullSafe(F.col("_k")) & (F.col("field") == F.col("_field")) & (F.xxhash64("text") == F.col("_id"))
    joined = values.join(side, same).select("k", "field", "text", "subs").dropDuplicates(["k", "field", "text"])
    return joined.select(F.col("k").alias(key), "field", "text", put_back("text", "subs").alias("restored"))
