"""Personal data replaced by surrogates.

Entities are found in whole texts; each distinct entity (its normal form, so that
differently written mentions refer to one) gets a keyed surrogate of its type:
digits pass a keyed permutation of their own length, check digits are made right again,
names keep gender and script, addresses and secrets keep their shape. Given names and surnames
are entities of their own, whatever title or form a mention has, so that a person keeps one name throughout;
a given name's gender is its own if it is listed, else the one that titles right before it give it most often in all
texts. The words of a text's detected names are replaced where they stand bare in it too. A
distributed check finds surrogates that two entities share, or that are themselves an
entity of the texts, and gives the later one another, until none is left. Mentions
are then written in their own layout: separators, brackets and letter case stay.
"""

from __future__ import annotations

import hashlib
import hmac
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .spark_io import arrow_stage, cut, documents, join_heavy

_LETTER = rb"A-Za-z\x80-\xff"
_CAPITAL = rb"(?:[A-Z]|\xc3[\x80-\x9e]|\xd0[\x90-\xaf])[" + _LETTER + rb"'-]*"
#: Titles by gender.
MALE, FEMALE, EITHER = (b"Mr", b"Mister", b"Sir", b"Herr", b"Monsieur", b"Se\xc3\xb1or", b"Sr", b"Don"), (b"Mrs", b"Ms", b"Miss", b"Madam", b"Frau", b"Madame", b"Mme", b"Mlle", b"Se\xc3\xb1ora", b"Sra", b"Do\xc3\xb1a"), (b"Dr", b"Prof")
#: Given names by script and gender; the surrogate's comes from the mention's own list.
NAMES = {
    "latin": {"m": ("Adam", "Bruno", "Carl", "David", "Erik", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karim", "Louis"), "f": ("Alma", "Berta", "Clara", "Diana", "Elena", "Fanny", "Gloria", "Helga", "Irene", "Julia", "Karin", "Laura"), "n": ("Alex", "Chris", "Dominique", "Jamie", "Kim", "Lou", "Noa", "Robin", "Sam", "Toni", "Val", "Yael")},
    "cyrillic": {"m": ("Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван"), "f": ("Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина"), "n": ("Саша", "Женя", "Валя")},
}
SYLLABLES = {"latin": [c + v for c in ("b", "d", "f", "g", "k", "l", "m", "n", "p", "r", "s", "t", "v", "w", "st", "br") for v in ("a", "e", "i", "o")], "cyrillic": [c + v for c in "бвгдклмнпрстфхцш" for v in "аеио"]}

_PATTERNS = [
    ("secret", re.compile(rb"(?<![\w\x80-\xff])(?i:token|secret|passw(?:or)?d|api[_ -]?key|access[_ -]?key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?([^\s\"'\x00]{8,})"), 1),
    ("secret", re.compile(rb"(?<![\w\x80-\xff])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|[0-9a-f]{32,}|[0-9A-F]{32,})(?![\w\x80-\xff])"), 0),
    ("iban", re.compile(rb"(?<![\w\x80-\xff])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\w\x80-\xff])"), 0),
    ("ssn", re.compile(rb"(?<![\w\x80-\xff-])\d{3}-\d{2}-\d{4}(?![\w\x80-\xff-])"), 0),
    ("phone", re.compile(rb"(?<![\w\x80-\xff])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?![\w\x80-\xff])"), 0),
    ("phone", re.compile(rb"(?<![\w\x80-\xff])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w\x80-\xff])"), 0),
    ("card", re.compile(rb"(?<![\w\x80-\xff])\d(?:[ -]?\d){12,18}(?![\w\x80-\xff])"), 0),
    ("ip", re.compile(rb"(?<![\w\x80-\xff.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\w\x80-\xff]|\.\d)"), 0),
    ("person", re.compile(rb"(?<![\w\x80-\xff])(?:" + b"|".join(sorted((re.escape(t) for t in MALE + FEMALE + EITHER), key=len, reverse=True)) + rb")\.? (" + _CAPITAL + rb"(?: " + _CAPITAL + rb"){0,2})"), 1),
    ("person", re.compile(rb"(?<![\w\x80-\xff])(?i:my name is|name|contact)[:=]? (" + _CAPITAL + rb" " + _CAPITAL + rb")"), 1),
]
_LOCAL = re.compile(rb"[\w.%+\-\x80-\xff]+$")
_DOMAIN = re.compile(rb"(?:[\w\x80-\xff](?:[\w\-\x80-\xff]*[\w\x80-\xff])?\.)+[A-Za-z]{2,}")


def mentions(text: bytes) -> list[tuple[str, int, int, str]]:
    """(type, start, end, gender) of a text's entities in order, none overlapping; of overlapping ones the first type above counts."""
    found: list[tuple[int, int, int, str, str]] = []
    at = text.find(b"@")
    while at >= 0:
        left = at
        while left and (text[left - 1] >= 0x80 or chr(text[left - 1]).isalnum() or text[left - 1] in b"._%+-"):
            left -= 1
        while left < at and text[left] in b".-%+":
            left += 1
        m = _DOMAIN.match(text, at + 1)
        if left < at and m:
            found.append((0, left, m.end(), "email", ""))
        at = text.find(b"@", at + 1)
    for rank, (kind, pattern, group) in enumerate(_PATTERNS, 1):
        for m in pattern.finditer(text):
            a, b = m.span(group)
            gender = ""
            if kind == "person":
                title = m[0][: a - m.start()].strip(b" .")
                gender = "m" if title in MALE else "f" if title in FEMALE else "n"
            found.append((rank, a, b, kind, gender))
    found.sort()
    taken: list[tuple[str, int, int, str]] = []
    covered = bytearray(len(text)) if found else b""
    for _, a, b, kind, gender in found:
        if not any(covered[a:b]):
            covered[a:b] = b"\1" * (b - a)
            taken.append((kind, a, b, gender))
    return sorted(taken, key=lambda t: t[1])


_WORD = re.compile(rb"(?<![\w\x80-\xff])" + _CAPITAL + rb"(?![\w\x80-\xff])")
_LISTED = {name.casefold(): g for lists in NAMES.values() for g in "mf" for name in lists[g]}


def pieces(text: bytes) -> list[tuple[str, int, int, str, int]]:
    """As mentions(), persons cut into names: (type, start, end, gender, place within the mention). The last name of a mention is a
    surname, those before are given names; then come bare words that are names of the text's persons."""
    out: list[tuple[str, int, int, str, int]] = []
    known: dict[str, str] = {}
    covered = None
    for kind, a, b, gender in mentions(text):
        if kind != "person":
            out.append((kind, a, b, "", 0))
            continue
        words = [(m.start() + a, m.end() + a) for m in re.finditer(rb"\S+", text[a:b])]
        for i, (x, y) in enumerate(words):
            name = text[x:y].decode("utf-8", "replace").casefold()
            own = "surname" if i == len(words) - 1 else "given"
            out.append((own, x, y, _LISTED.get(name, "" if i else gender) if own == "given" else "", i))
            if own == "surname" or name not in known:
                known[name] = own
    if known:
        covered = bytearray(len(text))
        for _, a, b, _, _ in out:
            covered[a:b] = b"\1" * (b - a)
        for m in _WORD.finditer(text):
            a, b = m.span()
            own = known.get(m[0].decode("utf-8", "replace").casefold())
            if own and not any(covered[a:b]):
                out.append((own, a, b, "", 0))
        out.sort(key=lambda t: t[1])
    return out


def normal(kind: str, surface: str, gender: str) -> str:
    """What all mentions of one entity have in common."""
    if kind in ("phone", "card", "ssn"):
        return ("+" if surface.startswith("+") else "") + re.sub(r"\D", "", surface)
    if kind == "iban":
        return surface.replace(" ", "")
    if kind == "email":
        return surface.lower()
    if kind in ("given", "surname"):
        return surface.casefold()
    return f"{gender}:{' '.join(surface.split()).casefold()}" if kind == "person" else surface


def _prf(key: bytes, *parts: object) -> int:
    return int.from_bytes(hmac.new(key, "\x1f".join(map(str, parts)).encode(), hashlib.sha256).digest()[:16], "big")


def permute(key: bytes, tweak: str, value: int, size: int) -> int:
    """A keyed permutation of range(size): an alternating Feistel network over a * b >= size, walked until within."""
    a = int(size**0.5) + 1
    while True:
        x, y = divmod(value, a)
        for r in range(8):
            if r % 2:
                y = (y + _prf(key, tweak, r, x)) % a
            else:
                x = (x + _prf(key, tweak, r, y)) % a
        value = x * a + y
        if value < size:
            return value


def _luhn(digits: str) -> int:
    total = sum((2 * d - 9 * (d > 4)) if i % 2 else d for i, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def _iban_check(country: str, rest: str) -> str:
    value = int("".join(str(int(c, 36)) for c in rest + country + "00"))
    return f"{98 - value % 97:02d}"


def _digits(key: bytes, tweak: str, digits: str) -> str:
    return f"{permute(key, f'{tweak}/{len(digits)}', int(digits), 10 ** len(digits)):0{len(digits)}d}" if digits else ""


def _shape(key: bytes, tweak: str, text: str, more: int) -> str:
    """Letters become letters of the same case and script, digits digits, hex stays hex; `more` letters are added."""
    out = []
    value = _prf(key, tweak, text)
    hexa = len(text) >= 16 and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text) is not None
    for i, c in enumerate(text):
        if i % 16 == 15:
            value = _prf(key, tweak, text, i)
        if hexa:
            value, r = divmod(value, 16)
            out.append("0123456789abcdef"[r] if text == text.lower() else "0123456789ABCDEF"[r])
        elif c.isdigit():
            value, r = divmod(value, 10)
            out.append(str(r))
        elif c.isalpha():
            alphabet = "абвгдежзиклмнопрстуфхц" if "Ѐ" <= c <= "ӿ" else "abcdefghijklmnopqrstuvwxyz"
            value, r = divmod(value, len(alphabet))
            out.append(alphabet[r].upper() if c.isupper() else alphabet[r])
        else:
            out.append(c)
    value = _prf(key, tweak, text, "more")
    for _ in range(more):
        value, r = divmod(value, 26)
        out.append(chr(97 + r))
    return "".join(out)


def _name(key: bytes, kind: str, word: str, gender: str, attempt: int) -> str:
    """A given name of the gender's list, later ones made of syllables with the gender's ending; a surname of syllables."""
    script = "cyrillic" if any("Ѐ" <= c <= "ӿ" for c in word) else "latin"
    value = _prf(key, f"{kind}/{attempt}", word)
    if kind == "given" and not attempt:
        names = NAMES[script][gender or "n"]
        return names[value % len(names)]
    n = attempt + (3 if kind == "surname" else 1)
    ending = {"latin": {"m": "n", "f": "na"}, "cyrillic": {"m": "н", "f": "на"}}[script].get(gender, "") if kind == "given" else ""
    return ("".join(SYLLABLES[script][value // 64**i % 64] for i in range(n)) + ending).capitalize()


def surrogate(key: bytes, kind: str, norm: str, attempt: int = 0, gender: str = "") -> str:
    """The entity's surrogate; another one for every attempt. `gender` is that of a given name."""
    tweak = f"{kind}/{attempt}"
    if kind in ("given", "surname"):
        return _name(key, kind, norm, gender, attempt)
    if kind == "phone":
        keep = 2 if norm.startswith("+") else 0
        return norm[:keep] + _digits(key, tweak, norm[keep:])
    if kind == "card":
        if _luhn(norm[:-1] + "0") == int(norm[-1]):
            body = norm[0] + _digits(key, tweak, norm[1:-1])
            return body + str(_luhn(body + "0"))
        return norm[0] + _digits(key, tweak, norm[1:])
    if kind == "ssn":
        area, rest = divmod(permute(key, tweak, (int(norm[:3]) - 1) % 899 * 10**6 + int(norm[3:]), 899 * 10**6), 10**6)
        return f"{1 + area:03d}{rest:06d}"
    if kind == "iban":
        rest = _shape(key, tweak, norm[4:], 0)
        rest = "".join(n if o.isalpha() else d for o, n, d in zip(norm[4:], rest, rest, strict=True))
        return norm[:2] + _iban_check(norm[:2], rest) + rest
    if kind == "ip":
        a, b, c, d = map(int, norm.split("."))
        v = permute(key, tweak, ((a % 223) << 24 | b << 16 | c << 8 | d), 223 << 24)
        return f"{1 + (v >> 24)}.{v >> 16 & 255}.{v >> 8 & 255}.{v & 255}"
    if kind == "email":
        local, _, domain = norm.partition("@")
        host, _, top = domain.rpartition(".")
        return f"{_shape(key, tweak, local, 2 + 2 * attempt)}@{_shape(key, 'host', host, 0)}.{top}"
    if kind == "person":
        gender, _, name = norm.partition(":")
        *given, last = name.split(" ")
        return " ".join([*(_name(key, "given", w, _LISTED.get(w, gender), attempt) for w in given), _name(key, "surname", last, "", attempt)])
    return _shape(key, tweak, norm, 0 if attempt < 3 else attempt)


def write(kind: str, surface: str, value: str) -> str:
    """The surrogate in the mention's layout."""
    if kind in ("phone", "card", "ssn"):
        digits = iter(re.sub(r"\D", "", value))
        return re.sub(r"\d", lambda _: next(digits), surface)
    if kind == "iban":
        letters = iter(value)
        return re.sub(r"\S", lambda _: next(letters), surface)
    if kind in ("email", "person", "given", "surname"):
        return value.upper() if surface.isupper() else value.lower() if surface.islower() else value
    return value


def _keyed(docs: DataFrame, *more: str) -> DataFrame:
    return documents(docs, *more).withColumns({"k1": F.xxhash64("text"), "k2": F.coalesce("doc_id", F.lit(-(1 << 63)))})


def detect(docs: DataFrame) -> DataFrame:
    """(k1, k2, kind, start, end, surface, norm, gender, part) of all mentions, persons name by name (see pieces()); places in bytes of
    the UTF-8 text, k1 and k2 tell texts apart."""

    def each(batch):
        rows: list[tuple] = []
        k1, k2 = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        for a, b, data, offs in tv.batches(batch.column(1)):
            raw = data.tobytes()
            for i, (x, y) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True), a):
                text = raw[x:y]
                for kind, start, end, gender, part in pieces(text):
                    surface = text[start:end].decode("utf-8", "replace")
                    rows.append((k1[i], k2[i], kind, start, end, surface, normal(kind, surface, gender), gender, part))
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["k1", "k2", "kind", "start", "end", "surface", "norm", "gender", "part"]) if rows else None

    return arrow_stage(_keyed(docs), each, "k1 long, k2 long, kind string, start long, end long, surface string, norm string, gender string, part long")


def assign(found: DataFrame, key: bytes, rounds: int = 40) -> DataFrame:
    """(kind, norm, surrogate, n): distinct for distinct entities of a kind, and no entity of the texts itself;
    n is the number of the entity's mentions."""

    def each(batch):
        kind, norm, gender, attempt = (batch.column(i).to_pylist() for i in range(4))
        return pa.record_batch([*batch.columns, pa.array([surrogate(key, k, n, t, g) for k, n, g, t in zip(kind, norm, gender, attempt, strict=True)])], ["kind", "norm", "gender", "attempt", "surrogate"])

    hints = {g: F.count_if(F.col("gender") == g) for g in "mf"}
    gender = F.when(hints["m"] > hints["f"], "m").when(hints["f"] > hints["m"], "f").otherwise("n")
    real = cut(found.groupBy("kind", "norm").agg(F.count("*").alias("n"), gender.alias("gender")))
    names = real.select("kind", F.col("norm").alias("taken")).distinct()
    entities = real.select("kind", "norm", "gender", F.lit(0).cast("long").alias("attempt"))
    for _ in range(rounds):
        entities = cut(arrow_stage(entities, each, "kind string, norm string, gender string, attempt long, surrogate string"))
        first = entities.groupBy("kind", F.lower("surrogate").alias("s")).agg(F.min_by("norm", F.struct("attempt", "norm")).alias("owner"))
        seen = entities.withColumn("s", F.lower("surrogate")).join(first, ["kind", "s"]).join(names.withColumnRenamed("taken", "s").withColumn("real", F.lit(1)), ["kind", "s"], "left")
        judged = seen.select("kind", "norm", "gender", "attempt", "surrogate", ((F.col("norm") != F.col("owner")) | F.col("real").isNotNull()).alias("bad"))
        if judged.where("bad").isEmpty():
            return cut(entities.join(real.select("kind", "norm", "n"), ["kind", "norm"]).select("kind", "norm", "surrogate", "n"))
        entities = judged.select("kind", "norm", "gender", (F.col("attempt") + F.col("bad").cast("long")).alias("attempt"))
    raise RuntimeError(f"surrogates still collide after {rounds} rounds")


def replace(docs: DataFrame, key: bytes, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, n_entities, entities array<struct<kind, start, end, surrogate>>, *keep) of every document,
    with the surrogates in place of `key`, which must be kept secret: it undoes the numbers' permutation; start and end are places in bytes of the given text.

    A long number that fails a card's check digit is replaced too, by one that fails it as well. Null and empty texts come back empty. Repeated rows are treated alike; an empty table gives an empty
    result; further columns are passed on only if named in `keep`."""
    found = cut(detect(docs))
    lists = (
        join_heavy(found, assign(found, key), ["kind", "norm"], "n")
        .groupBy("k1", "k2")
        .agg(F.array_sort(F.collect_set(F.struct("start", "end", "kind", "surface", "surrogate", "part"))).alias("found"))
    )
    rows = _keyed(docs, *keep).join(lists, ["k1", "k2"], "left").select("doc_id", "text", "found", *keep)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("surrogate", pa.string())]))

    def each(batch):
        texts, said = [], []
        for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if found:
                raw, parts, at = text.encode(), [], 0
                for f in found:
                    parts += [raw[at : f["start"]], (new := write(f["kind"], f["surface"], f["surrogate"])).encode()]
                    f["new"], at = new, f["end"]
                text = b"".join([*parts, raw[at:]]).decode("utf-8", "replace")
            texts.append(text)
            told: list[dict] = []
            for f in found or ():
                if f["part"]:
                    # further names of the same person
                    whole = told[-1]
                    whole["surrogate"] += raw[whole["end"] : f["start"]].decode("utf-8", "replace") + f["new"]
                    whole["end"] = f["end"]
                else:
                    told.append({"kind": "person" if f["kind"] in ("given", "surname") else f["kind"], "start": f["start"], "end": f["end"], "surrogate": f["new"]})
            said.append(told)
        return pa.record_batch([batch.column(0), pa.array(texts, pa.string()), pa.array([len(x) for x in said], pa.int64()), pa.array(said, kind), *batch.columns[3:]], ["doc_id", "text", "n_entities", "entities", *keep])

    types = dict(docs.dtypes)
    return arrow_stage(rows, each, ", ".join(["doc_id long, text string, n_entities long, entities array<struct<kind:string,start:long,end:long,surrogate:string>>", *(f"`{c}` {types[c]}" for c in keep)]))
