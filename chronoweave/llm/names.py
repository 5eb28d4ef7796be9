"""Variant spellings of people's names, linked per owner (chair) by a pigeonhole segment join."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.operators.components import connected_components, shared_folder
from chronoweave.operators.sizes import sent_if_small

#: Edits allowed between two spellings of one surname; names are cut into one segment more.
EDITS = 3
#: Mistyped given names and patronymics are told from surnames if they have so many letters.
MISTYPED = (4, 16)
#: A part with a point after it is an abbreviation up to so many letters.
ABBREVIATED = 5

# Titles before a name.
TITLES = r"(?:профессор|проф|доцент|доц|ассистент|асс|старший|ст|преподаватель|преп|академик|акад|зав|каф|канд|докт|мед|наук|[кд]\s?[.]?\s?м\s?[.]?\s?н)"
# Words that stand where a name should.
STAND_INS = {"вакансия", "вакант", "вакантно", "назначению", "назначен", "назначена", "назначается", "преподаватель", "преподаватели", "кафедры", "кафедра", "уточняется", "нет", "неизвестно", "неизвестен", "сотрудник", "сотрудники", "почасовик", "замена", "дежурный", "tba", "tbd", "none", "null"}
# Given names, and short forms with the given names they stand for.
GIVEN = "александр александра алексей алина алла анастасия анатолий андрей анна антон антонина артем артур борис вадим валентин валентина валерий валерия варвара василий вера вероника виктор виктория виталий владимир владислав вячеслав галина геннадий георгий герман глеб григорий дарья денис диана дмитрий евгений евгения егор екатерина елена елизавета жанна захар зинаида зоя иван игорь илья инна ирина карина кира кирилл клавдия константин ксения лариса лев леонид лидия любовь людмила максим маргарита марина мария марк матвей михаил надежда наталья наталия николай никита нина оксана олег олеся ольга павел петр полина раиса римма роман руслан светлана семен сергей софия софья станислав степан таисия тамара татьяна тимофей тимур ульяна федор филипп эдуард элеонора эльвира эмилия эмма юлия юрий яков яна ярослав"
SHORT = "аня:анна ася:анастасия боря:борис вадик:вадим валя:валентина ваня:иван варя:варвара вася:василий вика:виктория витя:виктор влад:владислав вова:владимир володя:владимир галя:галина гена:геннадий гоша:георгий гриша:григорий даша:дарья дима:дмитрий митя:дмитрий женя:евгений зина:зинаида ира:ирина катя:екатерина коля:николай костя:константин ксюша:ксения лара:лариса лена:елена леня:леонид лева:лев леша:алексей алеша:алексей лида:лидия лиза:елизавета люба:любовь люда:людмила люся:людмила макс:максим маша:мария миша:михаил надя:надежда настя:анастасия наташа:наталья оля:ольга паша:павел петя:петр поля:полина рая:раиса рита:маргарита рома:роман саша:александр света:светлана сеня:семен сережа:сергей слава:вячеслав соня:софия стас:станислав степа:степан тася:таисия таня:татьяна тима:тимофей толя:анатолий тома:тамара федя:федор эдик:эдуард эля:эльвира юля:юлия юра:юрий яша:яков"

_GIVEN = set(GIVEN.split())
_SHORT = dict(x.split(":") for x in SHORT.split())
_PATRONYMIC = re.compile(r"(?:ович|евич|ьич|овна|евна|ична|инична)$")
_TITLE = re.compile(rf"^(?:{TITLES}[.:,\s]+)+")
_WORD = re.compile(r"([^\W\d_]+(?:-[^\W\d_]+)*)(\.?)(,?)")


def _near(a: str, b: str, most: int) -> bool:
    """Whether at most ``most`` edits (a swap of neighbours is one) lead from one word to the other."""
    if abs(len(a) - len(b)) > most:
        return False
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], before[j - 2] + 1)
        before, last = last, row
    return last[-1] <= most


def _deletes(word: str, most: int) -> set[str]:
    """The word with up to ``most`` letters left out."""
    out = last = {word}
    for _ in range(most):
        last = {w[:k] + w[k + 1 :] for w in last for k in range(len(w))}
        out = out | last
    return out


def _slack(name: str) -> int:
    return 2 if len(name) >= 7 else 1 if len(name) >= 4 else 0


_FULL = {n: n for n in _GIVEN} | _SHORT
_STEMS = {n[:-1] if n[-1] in "йьея" else n for n in _GIVEN if n[-1] not in "а"}
_FATHERS = {stem + end for stem in _STEMS for end in ("ович", "евич", "овна", "евна")}
_INDEX: dict[str, set[str]] = {}
for _name in _FULL.keys() | _FATHERS:
    for _part in _deletes(_name, _slack(_name)):
        _INDEX.setdefault(_part, set()).add(_name)


@lru_cache(500_000)
def _kind(word: str) -> tuple[str, str]:
    """What a word can be, and the initial it stands for: given, patronymic, the same with ``?`` if typed with typos, or surname."""
    if word in _FULL:
        return "given", _FULL[word][0]
    if _PATRONYMIC.search(word):
        return "patronymic", word[0]
    if MISTYPED[0] <= len(word) <= MISTYPED[1]:
        near = {n for part in _deletes(word, _slack(word)) for n in _INDEX.get(part, ())}
        near = {n for n in near if _near(word, n, _slack(n))}
        if near:
            name = min(near, key=lambda n: (n not in _FULL, n[0] != word[0], n))
            return ("given?", _FULL[name][0]) if name in _FULL else ("patronymic?", name[0])
    return "surname", ""


def parse_name(text: str | None) -> tuple[str, str, str] | None:
    """(surname, initial of the given name, initial of the patronymic), lower case with ё as е; empty where not given.

    None for a null, an empty text, signs only, stand-in words, and a text without a surname.
    """
    if text is None:
        return None
    text = text.replace(" ", " ").strip()
    glued = re.sub(r"([^\W\d_A-ZА-ЯЁ])(?=[А-ЯЁA-Z])", r"\1 ", text) if not text.isupper() else text
    glued = re.sub(r"\.(?=[^\W\d_])", ". ", glued)
    low = glued.lower().replace("ё", "е")
    while (cut := _TITLE.sub("", low)) != low and _WORD.search(cut):
        low = cut
    words = [(w, bool(dot), bool(comma)) for w, dot, comma in _WORD.findall(low)]
    # Two letters written together are two initials.
    words = [(part, dot, comma) for w, dot, comma in words for part in (w if len(w) == 2 and w not in _FULL else [w])]
    if not words or any(w in STAND_INS for w, _, _ in words):
        return None
    given = patronymic = ""
    kinds: list[tuple[str, str]] = []
    for k, (word, dot, comma) in enumerate(words):
        if len(word) == 1:
            kinds.append(("initial", word))
        elif comma and k == 0:
            kinds.append(("surname", ""))
        elif dot and len(word) <= ABBREVIATED:
            kinds.append(("short", _SHORT[word][0] if word in _SHORT else word[0]))
        else:
            kinds.append(_kind(word))
    for wanted in (("surname",), ("patronymic?", "given?"), ("given", "patronymic")):
        if surnames := [k for k, (kind, _) in enumerate(kinds) if kind in wanted]:
            break
    if not surnames:
        return None
    at = max(surnames, key=lambda k: (words[k][2] and k == 0, len(words[k][0])))
    for k, (kind, letter) in enumerate(kinds):
        if k == at:
            continue
        letter = letter or words[k][0][0]
        if kind.startswith("patronymic") and not patronymic:
            patronymic = letter
        elif not given:
            given = letter
        elif not patronymic:
            patronymic = letter
    return words[at][0], given, patronymic


_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("surname", "given", "patronymic")])


@F.pandas_udf(_SCHEMA)
def _parsed(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_name(t) or (None, None, None) for t in texts], columns=["surname", "given", "patronymic"])


def _allowed(size: F.Column) -> F.Column:
    """Edits allowed between two surnames, the shorter of which has so many letters: EDITS, but no more than a third of it."""
    return F.least(F.lit(EDITS), F.floor(size / 3)).cast("int")


@lru_cache
def _cuts(size: int) -> tuple[tuple[int, int], ...]:
    """Where the segments of a name of so many letters begin and end: one more than edits are allowed, of about equal length."""
    parts = min(EDITS, size // 3) + 1
    return tuple((size * k // parts, size * (k + 1) // parts) for k in range(parts))


@lru_cache
def _looks(size: int) -> tuple[tuple[bytes, int, int], ...]:
    """Which substrings of a name of so many letters can equal a segment of an equally long or shorter name within the allowed
    edits: (length of that name and number of its segment, where the substring begins, where it ends).

    A segment's place can be moved by no more than the segments left of it, and, counted from the end, by no more than
    those right of it: else another segment would have stayed whole, too.
    """
    out = []
    for less in range(EDITS + 1):
        other = size - less
        edits = min(EDITS, other // 3)
        if edits < max(1, less):
            continue
        for k, (start, stop) in enumerate(_cuts(other)):
            long = stop - start
            low, high = max(0, start - k, start + less - (edits - k)), min(size - long, start + k, start + less + (edits - k))
            out += [(b"%d,%d," % (other, k), at, at + long) for at in range(low, high + 1)]
    return tuple(out)


def _hashes(owner: str, name: str) -> tuple[list[int], list[int]]:
    """The segments of a name and its shifted substrings, as 64-bit hashes of owner, length, number and text."""
    head, text, size = f"{owner}\u0001".encode(), name.encode("utf-32-le"), len(name)
    digest = lambda what, a, z: xxhash.xxh3_64_intdigest(head + what + text[4 * a : 4 * z]) - 2**63
    segments = [digest(b"%d,%d," % (size, k), a, z) for k, (a, z) in enumerate(_cuts(size))] if size >= 3 else []
    return segments, [digest(*look) for look in _looks(size)]


@F.pandas_udf(T.StructType([T.StructField(n, T.ArrayType(T.LongType())) for n in ("segments", "probes")]))
def _hashed(owners: pd.Series, names: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_hashes(o, n) for o, n in zip(owners, names, strict=True)], columns=["segments", "probes"])


def near_names(names: DataFrame) -> DataFrame:
    """Pairs of different surnames of one owner that differ by few edits, in both directions: ``owner``, ``surname``,
    ``other``, ``distance``. ``names`` has each (``owner``, ``surname``) once, both texts.

    Pigeonhole: of one segment more than edits are allowed, at least one stays whole. Segments of the shorter name are an
    inverted index; the shifted substrings of the longer one are looked up in it, once per owner and surname, and candidates
    are verified by a banded edit distance. Keys are 64-bit hashes: one that collides only brings a candidate more.
    """
    shared_folder(names.sparkSession)
    hashed = names.select("owner", "surname", _hashed("owner", "surname").alias("h")).checkpoint()
    index = hashed.select(F.col("owner").alias("__owner"), F.col("surname").alias("other"), F.explode("h.segments").alias("__h"))
    probe = hashed.select("owner", "surname", F.explode(F.array_distinct("h.probes")).alias("__h"))
    once = (F.length("surname") > F.length("other")) | ((F.length("surname") == F.length("other")) & (F.col("surname") > F.col("other")))
    met = probe.join(index, "__h").where((F.col("owner") == F.col("__owner")) & once)
    near = met.select("owner", "surname", "other", F.levenshtein("surname", "other", EDITS).alias("distance"))
    near = near.where((F.col("distance") >= 0) & (F.col("distance") <= _allowed(F.length("other")))).distinct()
    return near.unionByName(near.select("owner", F.col("other").alias("surname"), F.col("surname").alias("other"), "distance"))


#: How much of a name is given: the surname alone, one initial, or both.
BARE, HALF, FULL = 0, 1, 2


def _links(nodes: DataFrame) -> DataFrame:
    """Which spellings of one owner can mean the same person: ``a`` with no more of a name than ``b``, surnames near or equal,
    and the initials that ``a`` has equal. ``a``, ``b``, their kinds, ``distance``."""
    # As many tasks as a shuffle has: a name is short, but costs dozens of substrings.
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = nodes.repartition(parts, "owner", "surname").select("owner", "surname").distinct()
    near = near_names(names).unionByName(names.select("owner", "surname", F.col("surname").alias("other"), F.lit(0).alias("distance")))
    held = sent_if_small(nodes)
    a = held.select("owner", "surname", F.col("id").alias("a"), F.col("kind").alias("a_kind"), F.col("given").alias("g"), F.col("patronymic").alias("p"))
    b = held.select("owner", F.col("surname").alias("other"), F.col("id").alias("b"), F.col("kind").alias("b_kind"), "given", "patronymic")
    if held is not nodes:
        a, b = F.broadcast(a), F.broadcast(b)
    met = near.join(a, ["owner", "surname"]).join(b, ["owner", "other"])
    fits = (F.col("a_kind") < F.col("b_kind")) | ((F.col("a_kind") == F.col("b_kind")) & (F.col("a") < F.col("b")))
    fits = fits & ((F.col("a_kind") == BARE) | (F.col("g") == F.col("given"))) & ((F.col("a_kind") < FULL) | (F.col("p") == F.col("patronymic")))
    return met.where(fits).select("a", "a_kind", "b", "b_kind", "distance")


def _grouped(ids: DataFrame, links: DataFrame) -> DataFrame:
    """Persons made of linked spellings: ``id``, ``person`` (one of the ids)."""
    found = connected_components(links, "a", "b").withColumnRenamed("node", "id")
    return ids.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("person"))


def person_rows(df: DataFrame, row_id: str, owner: str, name: str) -> DataFrame:
    """The rows that name a person, with a number for the person: ``row_id``, ``owner``, ``name``, ``person``, ``spelled``
    (owner, surname and initials as one text).

    Names are parsed into surname and initials (titles, letter case, order of parts, short forms and ё are no difference).
    Distinct ones of an owner are linked in three steps, so that a spelling with less in it never joins two people:
    spellings with both initials, if the initials are equal and the surnames near; then those with the given name only, to
    the one nearest person of that initial; then bare surnames, to the one nearest person. Those left over form persons
    among themselves. Two equally near persons leave a spelling unlinked.

    All three steps work on one table of links, made by one segment join of the distinct surnames of each owner.

    A null owner owns nobody; null, empty and stand-in names name nobody; those rows are left out, and so are rows with a
    null id. An empty table gives no rows.
    """
    shared_folder(df.sparkSession)
    texts = df.where(F.col(name).isNotNull() & F.col(owner).isNotNull()).select(F.col(owner).alias("o"), F.col(name).alias("n")).distinct()
    # Filtered after it was written, else names would be parsed twice.
    parsed = texts.select("o", "n", _parsed("n").alias("p")).checkpoint().select("o", "n", F.col("o").cast("string").alias("owner"), "p.*").where("surname IS NOT NULL")
    key = ["owner", "surname", "given", "patronymic"]
    kind = F.when(F.col("patronymic") != "", FULL).when(F.col("given") != "", HALF).otherwise(BARE)
    # Numbers are given once: what is read from the checkpoint has them already.
    nodes = parsed.select(*key).distinct().select(*key, kind.alias("kind"), F.monotonically_increasing_id().alias("id")).checkpoint()
    links = _links(nodes).checkpoint()
    between = lambda a, b: links.where((F.col("a_kind") == a) & F.col("b_kind").isin(b))
    of = lambda k: nodes.where(F.col("kind") == k).select("id")
    person = _grouped(of(FULL), between(FULL, [FULL]))
    for step, known in ((HALF, [FULL]), (BARE, [HALF, FULL])):
        met = between(step, known).join(person.withColumnRenamed("id", "b"), "b")
        least = met.groupBy(F.col("a").alias("id")).agg(F.min(F.struct("distance", "person")).alias("first"), F.max(F.struct(-F.col("distance"), "person")).alias("last"))
        placed = least.where("first.person = last.person").select("id", "first.person").checkpoint()
        rest = of(step).join(placed, "id", "left_anti")
        own = between(step, [step]).join(placed.withColumnRenamed("id", "a"), "a", "left_anti").join(placed.withColumnRenamed("id", "b"), "b", "left_anti")
        person = person.unionByName(placed).unionByName(_grouped(rest, own))
    spelled = parsed.join(nodes.select(*key, "id"), key).join(person, "id").select("o", "n", "person", F.concat_ws("\u0001", *key).alias("spelled")).checkpoint()
    rows = df.where(F.col(row_id).isNotNull()).select(F.col(row_id).alias("r"), F.col(owner).alias("o"), F.col(name).alias("n"))
    return rows.join(sent_if_small(spelled), ["o", "n"]).select(F.col("r").alias(row_id), F.col("o").alias(owner), F.col("n").alias(name), "person", "spelled")


def people(df: DataFrame, row_id: str, owner: str, name: str) -> DataFrame:
    """The same with a name for the person that doesn't depend on the run: the first of the person's spellings.
    ``row_id``, ``owner``, ``name``, ``person``."""
    rows = person_rows(df, row_id, owner, name)
    called = rows.groupBy("person").agg(F.min("spelled").alias("called"))
    return rows.join(called, "person").select(row_id, owner, name, F.col("called").alias("person"))
