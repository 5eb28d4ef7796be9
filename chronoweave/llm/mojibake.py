"""Text that was read in a wrong character encoding: found, and brought back."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.operators.components import shared_folder
from chronoweave.operators.sizes import sent_if_small

# Encodings in which text may have been stored, and those in which it may have been read.
STORED_CYRILLIC = ("utf-8", "cp1251", "koi8-r", "cp866", "mac-cyrillic", "iso8859-5")
STORED_LATIN = ("utf-8", "cp1252", "mac-roman", "cp850")
READ = ("cp1252", "latin-1", "cp1251", "koi8-r", "cp866", "mac-cyrillic", "iso8859-5", "mac-roman", "cp850", "cp437")
#: Read wrongly, stored as UTF-8 and read wrongly again.
TWICE = ("cp1252", "latin-1", "cp1251")
# What stands for a byte that the reading encoding doesn't have: the control character, a question mark, the replacement character, nothing.
LOST = ("c1", "?", "�", "")
#: Words are runs of letters, of anything outside ASCII, and of question marks (which may stand for lost bytes).
WORD = r"[A-Za-z?\x7f-\x{10ffff}]+"
# Signs outside ASCII that stand before letters of clean text, and those that stand after letters.
BEFORE = "«»“”„‘’–—…№°±−×§"
AFTER = "«»“”„‘’–—…"


def _runs(script: str) -> str:
    """Letters of one script with usual case: small, large, or one large and then small ones; signs between and around them."""
    small, large = rf"[\p{{Is{script}}}&&\p{{Ll}}]", rf"[\p{{Is{script}}}&&\p{{Lu}}]"
    return rf"^[{BEFORE}\p{{So}}]*(?:(?:{large}?{small}+|{large}+)(?:[{AFTER}]+|$))*$"


#: A clean word: letters of one script with usual letter case, and clean signs.
NATURAL = rf"{_runs('Cyrillic')}|{_runs('Latin')}"


@lru_cache
def _reading(encoding: str, lost: str) -> tuple[str, ...]:
    """What each byte is read as; undefined bytes as ``lost`` says."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b) if lost == "c1" else lost)
    return tuple(out)


@lru_cache
def _undefined(encoding: str) -> frozenset[int]:
    marked = _reading(encoding, "?")
    return frozenset(b for b in range(128, 256) if marked[b] == "?")


def garbled_forms(word: str) -> list[tuple[str, str]]:
    """All ways in which a clean word can be garbled: (form, chain of encodings)."""
    cyrillic = any("Ѐ" <= c <= "ԯ" for c in word)
    out: dict[str, str] = {}
    for stored in STORED_CYRILLIC if cyrillic else STORED_LATIN:
        try:
            data = word.encode(stored)
        except UnicodeEncodeError:
            continue
        for read in READ:
            if read == stored or (stored == "cp1252" and read == "latin-1"):
                continue
            hurt = not _undefined(read).isdisjoint(data)
            for lost in LOST if hurt else LOST[:1]:
                form = "".join(map(_reading(read, lost).__getitem__, data))
                if form != word:
                    out.setdefault(form, f"{stored}>{read}")
            if stored == "utf-8" and read in TWICE:
                again = "".join(map(_reading(read, "c1").__getitem__, data)).encode()
                for lost in LOST if not _undefined(read).isdisjoint(again) else LOST[:1]:
                    out.setdefault("".join(map(_reading(read, lost).__getitem__, again)), f"{stored}>{read}>{stored}>{read}")
    return list(out.items())


def _generate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cut = regex.compile(r"[A-Za-z?\x7f-\U0010ffff]+")
    for batch in batches:
        words, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lo in range(0, len(words), 2000):
            form, origin, chain, weight = [], [], [], []
            for word, n in zip(words[lo : lo + 2000], counts[lo : lo + 2000], strict=True):
                for text, how in garbled_forms(word):
                    # The form is met in texts as one word, or not as a word at all.
                    if (m := cut.search(text)) and m.group() == text:
                        form.append(text)
                        origin.append(word)
                        chain.append(how)
                        weight.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(form, pa.string()), pa.array(origin, pa.string()), pa.array(chain, pa.string()), pa.array(weight, pa.int64())], ["form", "origin", "chain", "n_origin"])


def _natural(word: Column) -> Column:
    """Whether a word can be clean: one script, usual letter case, and if Latin not mostly made of letters outside ASCII."""
    ascii_letters = F.length(F.regexp_replace(word, "[^A-Za-z]", ""))
    letters = F.length(F.regexp_replace(word, r"[^\p{L}]", ""))
    few = ~word.rlike(r"\p{IsLatin}") | (ascii_letters * 5 >= letters * 2) | (letters <= 1)
    return word.rlike(NATURAL) & few


def words(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The distinct words outside ASCII of each document, as they stand and without question marks around them: ``doc``, ``word``."""
    every = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)))
    found = F.filter(every, lambda w: F.octet_length(w) > F.char_length(w))
    bare = F.transform(F.filter(found, lambda w: w.contains("?")), lambda w: F.regexp_replace(w, r"^\?+|\?+$", ""))
    return df.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc"), F.explode(F.array_union(found, bare)).alias("word"))


def known_forms(tokens: DataFrame) -> DataFrame:
    """The corpus's words that are garbled forms of its clean words: ``form``, ``origin``, ``chain``, ``strong``.

    Every distinct clean word is garbled under all encoding chains; the forms are hash-joined with the distinct words of the
    corpus. A form with characters that clean words don't have is strong. Any other form (letters of one or two scripts, such
    as caps lock and a wrong keyboard layout make, too) counts only if its original is in more documents: of two words that are
    each other's garbled form the more frequent one is clean. It is weak, or strong if its original is in ten times as many
    documents and it can't be a clean word or is too long to be another word's form by chance.
    """
    vocabulary = tokens.groupBy("word").agg(F.count("*").alias("n")).withColumn("natural", _natural(F.col("word"))).checkpoint()
    forms = vocabulary.where("natural").select("word", "n").mapInArrow(_generate, "form string, origin string, chain string, n_origin bigint")
    met = forms.join(vocabulary.select(F.col("word").alias("form"), F.col("n").alias("n_form"), "natural"), "form")
    # One character says nothing: every byte of a one-byte encoding is some letter or sign.
    form = F.col("form")
    sure = form.rlike(rf"[^\p{{L}}\p{{M}}?{BEFORE}\x{{1F000}}-\x{{1FFFF}}]") | form.rlike(r"\p{L}[°±×§]") | form.rlike(r"^[\p{IsLatin}&&[^A-Za-z]]{4,}$")
    met = met.withColumn("sure", sure & ~F.col("natural")).where((F.char_length("form") > 1) & (F.col("sure") | (F.col("n_origin") > F.col("n_form"))))
    strong = F.col("sure") | ((~F.col("natural") | (F.char_length("form") >= 5)) & (F.col("n_origin") >= 10 * F.col("n_form")))
    by = F.struct("n_origin", "origin", "chain")
    best = met.groupBy("form").agg(F.max(by).alias("b"), F.max(strong).alias("strong"))
    return best.select("form", F.col("b.origin").alias("origin"), F.col("b.chain").alias("chain"), "strong")


def garbled(df: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The garbled documents (``doc``, ``chain``) and their garbled words (``doc``, ``form``, ``origin``, ``chain``).

    A document is garbled if it holds a strong form, or two different weak forms of one chain. The forms that the corpus holds
    are measured: if they are small they are sent to every task, and words are looked up where they are cut. Null ids and null or empty
    texts have no words. An empty table gives no rows. Whole texts are read; every word counts.
    """
    shared_folder(df.sparkSession)
    tokens = words(df, doc_id, text)
    forms = known_forms(tokens).checkpoint()
    hits = tokens.where("doc IS NOT NULL").join(sent_if_small(forms.withColumnRenamed("form", "word")), "word").select("doc", F.col("word").alias("form"), "origin", "chain", "strong").checkpoint()
    chains = hits.groupBy("doc", "chain").agg(F.count_distinct("form").alias("n"), F.max("strong").alias("strong"))
    docs = chains.where("strong OR n >= 2").groupBy("doc").agg(F.max_by("chain", F.struct("n", "chain")).alias("chain"))
    return docs, hits


def _undo(word: str, chain: str) -> str:
    """The word with a chain of encodings taken back, or as it is where that can't be."""
    steps = chain.split(">")
    text = word
    for stored, read in reversed(list(zip(steps[::2], steps[1::2], strict=True))):
        back = {c: b for b, c in enumerate(_reading(read, "c1"))}
        data = bytearray()
        for c in text:
            if c not in back:
                return word
            data.append(back[c])
        try:
            text = data.decode(stored)
        except UnicodeDecodeError:
            return word
    return text


_CUT = regex.compile(r"[A-Za-z?\x7f-\U0010ffff]+")
_CLEAN = regex.compile("(?V1)" + NATURAL.replace(r"\p{Is", r"\p{"))
_ODD = regex.compile(r"[\x7f-\U0010ffff]")


def restore(text: str, known: dict[str, str], chain: str) -> str:
    """The text with known garbled words replaced. Another word is taken back through the chain if it can't be clean and the
    outcome can, or if it follows a garbled word, is in capitals, and becomes small letters (Cyrillic read as Cyrillic); a
    single letter, if garbled words stand on both sides."""
    found = list(_CUT.finditer(text))
    garbled_ = [m.group() in known or m.group().strip("?") in known or not _CLEAN.match(m.group()) for m in found]
    out, at, after = [], 0, False
    for k, m in enumerate(found):
        word, bare = m.group(), m.group().strip("?")
        new = known.get(word)
        if new is None and bare in known:
            new = word.replace(bare, known[bare], 1)
        if new is None and _ODD.search(word):
            plain = _undo(word, chain)
            inside = after and (word.isupper() or len(word) == 1) and plain.islower() and (len(word) > 1 or (k + 1 < len(found) and garbled_[k + 1]))
            if plain != word and _CLEAN.match(plain) and (inside or not _CLEAN.match(word)):
                new = plain
        out += [text[at : m.start()], word if new is None else new]
        at, after = m.end(), new is not None
    return "".join([*out, text[at:]])


@F.pandas_udf(T.StringType())
def _restored(texts: pd.Series, forms: pd.Series, origins: pd.Series, chains: pd.Series) -> pd.Series:
    rows = zip(texts, forms, origins, chains, strict=True)
    return pd.Series([restore(text, dict(zip(form, origin, strict=True)), chain) for text, form, origin, chain in rows])


def restored(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The garbled documents with their text brought back: ``doc_id``, ``text``, ``chain``, ``restored``.

    A garbled word that is a known form becomes its original; another word of the document is taken back through the
    document's most frequent chain of encodings if that gives clean letters of one script. Lost bytes come back only in
    words whose lossy form is known. The words of a document gathered for it are bounded by its distinct words.
    """
    docs, hits = garbled(df, doc_id, text)
    known = hits.where("form <> origin").groupBy("doc").agg(F.collect_list("form").alias("forms"), F.collect_list("origin").alias("origins"))
    rows = df.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).join(docs, "doc").join(known, "doc")
    return rows.select(F.col("doc").alias(doc_id), "text", "chain", _restored("text", "forms", "origins", "chain").alias("restored"))
