"""Personal data replaced by keyed surrogates of the same kind, script and format.

An entity is a kind and a normal form (digits of a number, lower-case letters of an address or name), however it was
written. Its surrogate is drawn from a keyed hash of both, so the same entity gets the same surrogate everywhere, and
is then poured into the format that each mention had. All distinct entities of the corpus are checked: where two would
share a surrogate, or a surrogate is itself an entity of the corpus, all but the first draw again until none clash.
Later draws are longer ones, so that a shape whose forms are all taken has room as well.

Every pattern is linear in the length of a text: an address is looked for on both sides of each ``@`` only.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import free_name, refuse_clash, staged, text_or_empty

#: Redrawn entities that tasks hold in memory at most; more are joined to the documents that mention them.
HELD_REDRAWS = 200_000
#: From this draw on a surrogate is longer than what it stands for, by a place more for each further draw.
LONGER_FROM = 6

# Given names by gender and script, and the titles before names.
GIVEN = {
    ("m", "latin"): "adam alan albert andrew anton bernard brian carlos charles daniel david diego edward emil eric felix frank fritz george hans harold henri hugo ivan jack james jean john jorge jose karl kevin klaus lars laurent louis lukas marco mark martin michael nicolas oliver oscar otto pablo patrick paul peter philip pierre rafael ralph richard robert roger simon stefan steven thomas victor walter william".split(),
    ("f", "latin"): "alice amelie andrea angela anna barbara beatrice camille carmen caroline catherine chloe clara claudia diana elena elisabeth emily emma eva florence frieda gabriela greta hannah helen ines irene isabel jane jennifer jessica julia karen katrin laura lena linda lisa lucia luisa margaret maria marie martha monica nadine nancy nicole olivia patricia paula petra rachel rosa sandra sarah silvia sofia sophie susan teresa ursula veronica".split(),
    ("m", "cyrillic"): "александр алексей андрей борис виктор владимир дмитрий иван игорь николай олег павел сергей юрий".split(),
    ("f", "cyrillic"): "анна вера галина екатерина елена ирина лариса людмила мария наталья ольга светлана татьяна юлия".split(),
}
TITLES = {
    "m": "Mr Mister Herr Monsieur Sr Señor Don господин".split(),
    "f": "Mrs Ms Miss Frau Fräulein Mme Madame Mlle Sra Señora Srta Doña госпожа".split(),
    "": "Dr Doctor Doktor Docteur Prof Professor Professeur Profesor доктор профессор".split(),
}
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe fi fo ga ge gi go ka ke ki ko la le li lo ma me mi mo na ne ni no pa pe pi po ra re ri ro sa se si so ta te ti to va ve vi vo".split(),
    "cyrillic": "ба бе би бо да де ди до га ге ги го ка ке ки ко ла ле ли ло ма ме ми мо на не ни но па пе пи по ра ре ри ро са се си со та те ти то".split(),
}
VOWELS, CONSONANTS = "aeiou", "bcdfghjklmnpqrstvwxz"

_GENDER = {(name, script): g for (g, script), names in GIVEN.items() for name in names}
_TITLE = {t.lower(): g for g, ts in TITLES.items() for t in ts}
_WORD = r"[^\W\d_]+(?:(?:-|['’](?![sS](?!\w)))[^\W\d_]+)*"  # a possessive ending isn't part of the word

_CASED = "A-Za-zÀ-ÖØ-öø-ɏͰ-ϿЀ-ԯ"  # scripts with capitals, which put blanks around an address
_DOMAIN = re.compile(rf"[{_CASED}0-9.-]+")
_LETTERS = re.compile(rf"[{_CASED}]+")
_LOCAL = frozenset(c for c in map(chr, range(0x530)) if re.match(rf"[{_CASED}0-9_.+-]", c))
_DIGITS = re.compile(r"\+?\(?\d[\d().\- ]{5,}\d", re.ASCII)
_IP = re.compile(r"(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}", re.ASCII)
_CARD = re.compile(r"(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})", re.ASCII)
_SSN = re.compile(r"\d{3}-\d{2}-\d{4}", re.ASCII)
_PHONE = re.compile(r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[-. ]\d{4}|\d{3}[-.]\d{3}[-.]\d{4}|0\d{1,4}[ -]\d{3,8}(?:[ -]\d{2,5}){0,2}", re.ASCII)
_IP6 = re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f]*:[0-9A-Fa-f]*:)[0-9A-Fa-f:]{6,39}(?![\w:])", re.ASCII)
_SECRET = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,}|(?:AKIA|ghp_|sk-|xox[bp]-)[0-9A-Za-z_-]{12,})(?![0-9A-Za-z])", re.ASCII)
_IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])", re.ASCII)
_ONE_TITLE = f"(?:{'|'.join(t for ts in TITLES.values() for t in ts)})"
_TITLED = re.compile(rf"(?<!\w)((?:{_ONE_TITLE}\.? ){{0,3}}{_ONE_TITLE})\.? ({_WORD})(?: ({_WORD}))?")
_CAPITAL = "[A-ZÀ-ÖØ-ÞА-ЯЁ]"
_ANY_WORD = re.compile(_WORD)
_TWO = re.compile(rf"((?<!\w)(?<!\w[-'’]){_CAPITAL}(?:[^\W\d_]|(?<=\w)[-'’](?=[^\W\d_]))*) ({_WORD})(?!\w)")


def script_of(word: str) -> str:
    """The script of a word's first letter, as the first word of its Unicode name: latin, cyrillic, greek, cjk, ..."""
    return unicodedata.name(word[0], "LATIN").split()[0].split("-")[0].lower()


def _is_name(word: str) -> bool:
    """Capitalised, or of a script that has no capitals."""
    return word[0].isupper() or unicodedata.category(word[0]) == "Lo"


def luhn_ok(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _iban_ok(text: str) -> bool:
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _numbers(text: str) -> Iterator[tuple[int, int, str, str]]:
    for m in _DIGITS.finditer(text):
        at, stop = m.span()
        while at < stop:
            for kind, pattern in (("ip", _IP), ("card", _CARD), ("ssn", _SSN), ("phone", _PHONE)):
                hit = pattern.match(text, at, m.end())
                if not hit or at and (text[at - 1].isalnum() or text[at - 1] == "." and kind == "ip"):
                    continue
                end = hit.end()
                if end < len(text) and (text[end].isalnum() or kind == "ip" and text[end : end + 1] == "." and text[end + 1 : end + 2].isdigit()):
                    continue
                digits = re.sub(r"\D", "", hit[0])
                if kind == "phone" and not 8 <= len(digits) <= 15 or kind == "card" and not luhn_ok(digits):
                    continue
                yield at, end, kind, hit[0] if kind == "ip" else digits
                at = end - 1
                break
            at += 1


def _emails(text: str) -> Iterator[tuple[int, int, str, str]]:
    """Addresses: what can be one on both sides of each ``@``, so no character is looked at more than a few times."""
    at, past = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > past and text[begin - 1] in _LOCAL:
            begin -= 1
        while begin < at and not text[begin].isalnum():
            begin += 1
        end, stop = None, at + 1
        if begin < at and text[at - 1].isalnum() and (domain := _DOMAIN.match(text, at + 1)):
            for n, label in enumerate(domain[0].split(".")):
                if n and (top := _LETTERS.match(label)) and len(top[0]) >= 2:
                    end = stop + len(top[0])
                if not label or label[0] == "-" or label[-1] == "-":
                    break
                stop += len(label) + 1
        if end:
            yield begin, end, "email", text[begin:end].lower()
        past = end or at + 1
        at = text.find("@", past)


def _names(text: str) -> Iterator[tuple[int, int, str, str]]:
    """Given and family names: ``given:<gender>:<script>`` and ``family:<script>``.

    A name that follows a title or a known given name is one wherever else the text has it as a capitalised word.
    """
    kinds: dict[str, str] = {}
    for m in _TITLED.finditer(text):
        words = [m[g] for g in (2, 3) if m[g] and _is_name(m[g])]
        if not words or words[0] != m[2]:
            continue
        if len(words) == 2:
            script = script_of(words[0])
            told = "".join(_TITLE[t] for t in m[1].lower().replace(".", "").split())[:1]
            kinds.setdefault(words[0].lower(), f"given:{told or _GENDER.get((words[0].lower(), script), 'n')}:{script}")
        kinds[words[-1].lower()] = f"family:{script_of(words[-1])}"
    at = 0
    while m := _TWO.search(text, at):
        at = m.start(2)
        gender = _GENDER.get((m[1].lower(), script_of(m[1])))
        if gender and m[1][0].isupper() and m[2][0].isupper():
            kinds.setdefault(m[1].lower(), f"given:{gender}:{script_of(m[1])}")
            kinds[m[2].lower()] = f"family:{script_of(m[2])}"
    if kinds:
        for m in _ANY_WORD.finditer(text):
            kind = kinds.get(m[0].lower())
            if kind and _is_name(m[0]):
                yield *m.span(), kind, m[0].lower()


def find(text: str) -> list[tuple[int, int, str, str]]:
    """Mentions (start, stop, kind, normal form), disjoint and in order; of two that overlap, the earlier, then the longer."""
    found: list[tuple[int, int, str, str]] = []
    if "@" in text:
        found += _emails(text)
    found += [(*m.span(), "secret", m[0]) for m in _SECRET.finditer(text)]
    for m in _IBAN.finditer(text):
        plain = m[0].replace(" ", "")
        if 15 <= len(plain) <= 34 and _iban_ok(plain):
            found.append((*m.span(), "iban", plain))
    for m in _IP6.finditer(text):
        try:
            found.append((*m.span(), "ip6", ipaddress.IPv6Address(m[0]).compressed))
        except ValueError:
            pass  # a time of day, or another run of digits and colons
    found += _numbers(text)
    found += _names(text)
    found.sort(key=lambda f: (f[0], -f[1], f[2]))
    kept, end = [], 0
    for f in found:
        if f[0] >= end:
            kept.append(f)
            end = f[1]
    return kept


class _Stream:
    """An endless keyed sequence of numbers for one draw."""

    def __init__(self, key: bytes, kind: str, form: str, nth: int):
        self.key, self.name, self.block, self.held = key, f"{kind}\x00{form}\x00{nth}".encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.held) < 4:
            self.held += hmac.new(self.key, self.name + self.block.to_bytes(4, "big"), hashlib.sha256).digest()
            self.block += 1
        x, self.held = int.from_bytes(self.held[:4], "big"), self.held[4:]
        return x % n

    def like(self, c: str) -> str:
        if c.isdigit():
            return str(self.below(10))
        if "a" <= c <= "z":
            kin = VOWELS if c in VOWELS else CONSONANTS
            return kin[self.below(len(kin))]
        if "A" <= c <= "Z":
            return self.like(c.lower()).upper()
        return _kin(c)[self.below(len(_kin(c)))] if c.isalpha() else c


@lru_cache(maxsize=None)
def _ring(key: bytes, gender: str, script: str) -> dict[str, str]:
    """A keyed cycle through the names of a list: each stands for another, no two for the same."""
    order = sorted(GIVEN[gender, script], key=lambda n: hmac.new(key, n.encode(), hashlib.sha256).digest())
    return dict(zip(order, order[1:] + order[:1], strict=True))


def _syllables(s: _Stream, script: str, n: int) -> str:
    return "".join(SYLLABLES[script][s.below(len(SYLLABLES[script]))] for _ in range(n))


@lru_cache(maxsize=4096)
def _kin(c: str) -> str:
    """The letters of a character's own script and case among the 128 code points around it."""
    script, case = script_of(c), unicodedata.category(c)
    first = ord(c) >> 7 << 7
    return "".join(x for x in map(chr, range(first, first + 128)) if unicodedata.category(x) == case and script_of(x) == script) or c


def _name(s: _Stream, script: str, form: str, syllables: int, ends: dict[str, str]) -> str:
    if script in SYLLABLES:
        return _syllables(s, script, syllables) + ends[script]
    letters = form + form[-1:] * max(0, syllables - 3)
    return "".join(_kin(c)[s.below(len(_kin(c)))] if c.isalpha() else c for c in letters)


def draw(key: bytes, kind: str, form: str, nth: int = 0) -> str:
    """The nth surrogate of an entity, in normal form; from LONGER_FROM on longer than the entity."""
    s, more = _Stream(key, kind, form, nth), max(0, nth + 1 - LONGER_FROM)
    digits = lambda n: "".join(str(s.below(10)) for _ in range(n))
    if kind.startswith("given"):
        _, gender, script = kind.split(":")
        ring = _ring(key, gender, script) if (gender, script) in GIVEN else {}
        if form in ring:
            return ring[form]
        return _name(s, script, form, 2 + nth, {"latin": "na" if gender == "f" else "n", "cyrillic": "на" if gender == "f" else "н"})
    if kind.startswith("family"):
        return _name(s, kind.split(":")[1], form, 3 + nth, {"latin": "r", "cyrillic": "н"})
    if kind == "email":
        local, _, domain = form.partition("@")
        head, _, last = domain.rpartition(".")
        return "".join(map(s.like, local)) + "".join(s.like("b") for _ in range(more)) + "@" + "".join(map(s.like, head)) + "." + last
    if kind == "ip6" or kind == "ip" and nth > 256:  # that many draws fail only where nearly all IPv4 addresses are taken
        return ":".join(f"{1 + s.below(65535):x}" for _ in range(8))
    if kind == "ip":
        return ".".join(str(1 + s.below(254)) for _ in range(4))
    if kind == "card":
        body = form[0] + digits(len(form) - 2 + more)
        ends = [d for d in "0123456789" if luhn_ok(body + d)]
        return body + ends[s.below(len(ends))]
    if kind == "secret":
        head = re.match(r"AKIA|ghp_|sk-|xox[bp]-|", form)[0]
        if not head:
            sixteen = "0123456789ABCDEF" if form.upper() == form else "0123456789abcdef"
            return "".join(sixteen[s.below(16)] for _ in range(len(form) + more))
        return head + "".join(map(s.like, form[len(head) :])) + digits(more)
    if kind == "iban":
        body = "".join(map(s.like, form[4:])) + digits(more)
        check = 98 - int("".join(str(int(c, 36)) for c in body + form[:2] + "00")) % 97
        return f"{form[:2]}{check:02d}{body}"
    return form[:1] + digits(len(form) - 1 + more)  # phone, ssn


def pour(kind: str, surrogate: str, written: str) -> str:
    """A surrogate in the format of a mention: its separators, its capitals; what is longer comes last (in an address before the @)."""
    if kind in ("ip", "ip6", "secret"):
        return surrogate
    if kind.startswith(("given", "family")):
        return surrogate.upper() if written.isupper() and len(written) > 1 else surrogate[0].upper() + surrogate[1:] if written[0].isupper() else surrogate
    if kind == "email":
        halves = zip(surrogate.split("@"), written.split("@"), strict=True)
        return "@".join("".join(x.upper() if i < len(w) and w[i].isupper() and len(x.upper()) == 1 else x for i, x in enumerate(p)) for p, w in halves)
    source = iter(surrogate)
    return "".join(next(source) if c.isalnum() else c for c in written) + "".join(source)


def _entities(docs: DataFrame, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = {(kind, form) for text in batch.column(0).to_pylist() for _, _, kind, form in find(text)}
            yield pa.record_batch([pa.array([k for k, _ in seen], pa.string()), pa.array([f for _, f in seen], pa.string())], ["kind", "form"])

    return docs.select(text_or_empty(text_col).alias("text")).mapInArrow(run, "kind string, form string").distinct()


def _drawn(entities: DataFrame, key: bytes, nth: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [draw(key, k, f, nth) for k, f in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.record_batch([*batch.columns, pa.array(made, pa.string())], ["kind", "form", "surrogate"])

    return entities.select("kind", "form").mapInArrow(run, "kind string, form string, surrogate string")


def redrawn(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, form, nth) of the entities whose first draw is not theirs alone: nth is the draw that is.

    Given names of the fixed lists never draw again: they stand for each other, one for one.
    """
    spark = entities.sparkSession
    listed = spark.createDataFrame([(f"given:{g}:{s}", n) for (g, s), names in GIVEN.items() for n in names], "kind string, form string")
    present = entities.unionByName(listed).select("kind", F.col("form").alias("surrogate"))
    settled = spark.createDataFrame([], "kind string, form string, nth int")
    open_, taken, nth = entities.join(listed, ["kind", "form"], "left_anti"), None, 0
    while True:
        made = staged(_drawn(open_, key, nth), "draws")
        free = made.join(present, ["kind", "surrogate"], "left_anti")
        if taken is not None:
            free = free.join(taken, ["kind", "surrogate"], "left_anti")
        won = staged(free.groupBy("kind", "surrogate").agg(F.min("form").alias("form")), "surrogates")
        taken = won.select("kind", "surrogate") if taken is None else taken.unionByName(won.select("kind", "surrogate"))
        if nth:
            settled = settled.unionByName(won.select("kind", "form", F.lit(nth).alias("nth")))
        open_ = staged(made.select("kind", "form").join(won.select("kind", "form"), ["kind", "form"], "left_anti"), "open")
        if open_.isEmpty():
            return settled
        nth += 1


def _rewritten(text: str, key: bytes, nths: dict[tuple[str, str], int]) -> tuple[str, int, list[str]]:
    out, at, kinds = [], 0, []
    for start, stop, kind, form in find(text):
        out += [text[at:start], pour(kind, draw(key, kind, form, nths.get((kind, form), 0)), text[start:stop])]
        at = stop
        kinds.append(kind.split(":")[0])
    return "".join(out) + text[at:], len(kinds), kinds


def pseudonymise(docs: DataFrame, secret: bytes, text_col: str = "text", as_col: str = "surrogated", held_redraws: int = HELD_REDRAWS) -> DataFrame:
    """``docs`` with a struct (text, n_entities, kinds) in ``as_col``: the whole text with surrogates, and what was replaced.

    Kinds: email, ip, ip6, card (with a right check digit), ssn, phone, secret, iban, given (names), family. Different
    entities of a kind get different surrogates, none of which is itself an entity of that kind in ``docs``, except given
    names of the fixed lists: these are exchanged among each other. One entity gets one surrogate in all documents and
    formats. Who has ``secret`` can tell which surrogate stands for what; it has no default.

    * A null text is the empty one. Texts of any length are read whole, in linear time; rows that repeat are rewritten alike.
    * An empty table stays empty; the other columns stay as they are. A column named ``as_col`` raises.
    """
    refuse_clash(docs, as_col)
    if not secret:
        raise ValueError("an empty secret lets anyone undo the surrogates")
    spark = docs.sparkSession
    entities = staged(_entities(docs, text_col), "entities")
    again = staged(redrawn(entities, secret), "redraws")
    n = again.count()
    text = text_or_empty(text_col)
    if n <= held_redraws:
        held = spark.sparkContext.broadcast({(r["kind"], r["form"]): r["nth"] for r in again.collect()})  # held_redraws at most

        @F.pandas_udf("text string, n_entities long, kinds array<string>")
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for texts in parts:
                yield pd.DataFrame([_rewritten(t, secret, held.value) for t in texts], columns=["text", "n_entities", "kinds"])

        return docs.withColumn(as_col, run(text))
    return _joined(docs, again, secret, text_col, as_col)


def _joined(docs: DataFrame, again: DataFrame, secret: bytes, text_col: str, as_col: str) -> DataFrame:
    """The same where too many entities drew again: each text gets the draws of its own entities by a join."""

    def mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, k, f) for d, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k, f in {(k, f) for _, _, k, f in find(t)}]
            yield pa.record_batch([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["digest", "kind", "form"])

    text = text_or_empty(text_col)
    digest = F.sha2(text, 256)
    pairs = docs.select(digest.alias("digest"), text.alias("text")).mapInArrow(mentions, "digest string, kind string, form string").distinct()
    by_text = pairs.join(again, ["kind", "form"]).groupBy(F.col("digest").alias("__digest")).agg(F.collect_list(F.struct("kind", "form", "nth")).alias("__draws"))

    def one(text: str, draws) -> tuple[str, int, list[str]]:
        return _rewritten(text, secret, {(d["kind"], d["form"]): d["nth"] for d in (draws if draws is not None else [])})

    rewrite = F.udf(one, "text string, n_entities long, kinds array<string>", useArrow=True)
    key, of, draws = (free_name(docs, c) for c in ("__key", "__digest", "__draws"))
    met = docs.withColumn(key, digest).join(by_text.toDF(of, draws), F.col(key) == F.col(of), "left")
    return met.withColumn(as_col, rewrite(text, F.col(draws))).select(*docs.columns, as_col)
