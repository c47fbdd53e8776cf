"""Personal data replaced by keyed surrogates of the same type and format.

Found: e-mail addresses, telephone numbers, IPv4 and IPv6 addresses, payment cards (with a valid or an
invalid check digit alike), social security numbers, IBANs with valid check digits, access keys and long hexadecimal
tokens, passwords after `password=`, dates of birth after words that say so, street addresses, and names.  A name is a
listed given name before a capitalised word, or capitalised words after a title or another cue (`Mr`, `name is`, ...); the
given names and surnames that a text holds so are then found in it alone too.

A surrogate is a permutation of the values of its format that depends on `key`, a secret of the caller's: digits stay digits,
letters stay letters of their case, script and, in names, kind (vowel or consonant), separators stay, check digits stay as valid as they were.  Listed
given names go round in their list, within gender and script; a Slavic surname keeps its gender's ending.  Given name and surname are
entities of their own, so part of a name gets the same surrogate as within the whole.  Equal entities get
equal surrogates everywhere (an entity is compared in normal form: a telephone number by its digits,
an address or a name without case), different ones differ, and none is its own.  That is also checked: all distinct
entities of the corpus are brought together by their surrogate, and also compared with the
surrogates of others; an entity whose surrogate is its own or another's, or is itself found in the
corpus (but for given names, whose lists are closed), takes its next one, round by round until none is left; only these entities are listed.  From
attempt `LAST` on, when a short format may be used up, surrogates get a keyed ending.

Edge cases: a null or empty text stays as it is; a text without entities is unchanged; a null doc_id
is treated as any other row; repeated rows get the same result; an empty table gives no rows; texts of any length are taken whole;
further columns are ignored.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import STOP_WORDS
from .shared import kept, small_batches

#: Entities with a later attempt that may go to the tasks as a list.
LISTED = 50_000
LAST = 16
RESULT = "doc_id long, text string, n_entities int"
#: Given names by script and gender; each list is permuted within itself.
GIVEN = {
    ("latin", "f"): (
        "Amelia Beatrice Caroline Deborah Eleanor Francesca Gabriela Hannah Isabelle Josephine Katharina Margaret Natalie Patricia Rebecca Stephanie Theresa Veronica "
        "Alice Amanda Andrea Angela Anna Barbara Brenda Camille Carmen Carol Catherine Charlotte Chloé Christina Christine Claire Claudia Cynthia Diana Dolores Donna Dorothy Elena Elisabeth Elizabeth Emily Emma Eva Evelyn "
        "Frieda Greta Heather Helen Helga Inés Ingrid Jennifer Jessica Joan Judith Julia Julie Karen Katherine Kathleen Laura Lauren Linda Lisa Lucía Madeleine Maria Marie Marta Martha Mary Megan Melissa Michelle Monika "
        "Nancy Nathalie Nicole Olivia Pamela Petra Pilar Rachel Renate Rosa Ruth Sabine Samantha Sandra Sara Sarah Sharon Silvia Sofia Sophia Sophie Susan Susanne Teresa Ursula Valérie Victoria Virginia"
    ).split(),
    ("latin", "m"): (
        "Alexander Benjamin Christopher Dominic Edward Frederick Gregory Harold Jonathan Kenneth Lawrence Matthew Nicholas Patrick Richard Sebastian Theodore Vincent "
        "Aaron Adam Alan Alejandro Andreas Andrew Andrés Anthony Antoine Antonio Arthur Bernd Brandon Brian Carlos Charles Daniel David Dennis Diego Dieter Donald Douglas Eric Felix Fernando François Frank Friedrich Gary George Georg Gerald Gerhard "
        "Hans Heinrich Henri Henry Jack Jacob Jacques James Jason Javier Jean Jeffrey Joachim John José Joseph Joshua Juan Justin Jürgen Karl Keith Kevin Klaus Larry Laurent Louis Luis Manuel Martin Matthias Michael Michel Miguel "
        "Nathan Olivier Oscar Otto Pablo Paul Pedro Peter Philippe Pierre Rainer Ralph Raymond Robert Roger Ronald Ryan Samuel Scott Sergio Stefan Stephen Steven Thomas Timothy Walter Werner Wilhelm William Wolfgang Zachary"
    ).split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Евгения Екатерина Елена Ирина Ксения Людмила Мария Надежда Наталья Ольга Светлана Татьяна Юлия".split(),
    ("cyrillic", "m"): "Алексей Андрей Борис Василий Виктор Владимир Георгий Дмитрий Иван Константин Максим Михаил Николай Олег Павел Пётр Сергей Юрий".split(),
    ("greek", "f"): "Αγγελική Αικατερίνη Βασιλική Ελένη Ιωάννα Μαρία Σοφία".split(),
    ("greek", "m"): "Αλέξανδρος Γεώργιος Δημήτριος Ιωάννης Κωνσταντίνος Νικόλαος Παναγιώτης".split(),
}
_GIVEN = {n.lower(): (k, i) for k, ns in GIVEN.items() for i, n in enumerate(ns)}
_NAME = "|".join(sorted((re.escape(f) for ns in GIVEN.values() for n in ns for f in (n, n.upper())), key=len, reverse=True))
_WORD = r"[A-ZÀ-ÖØ-ÞЀ-ЯΆ-Ϋ][\w'’]*(?:-[A-ZÀ-ÖØ-ÞЀ-ЯΆ-Ϋ][\w'’]*)?"
_CUES = (
    "Mr Mrs Ms Miss Dr Prof Sir Herr Herrn Frau Monsieur Madame Mme Mlle Señor Señora Sr Sra Doña".split()
    + ["name is", "name:", "Name:", "Dear", "Contact:", "contact:", "heiße", "heisse", "m'appelle", "llamo", "Signed:", "signed by", "зовут", "господин", "госпожа", "κύριος", "κυρία"]
)

_EMAIL = re.compile(r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_KEY = re.compile(r"\bAKIA[A-Z0-9]{16}\b")
_PASSWORD = re.compile(r"(?<=password=)[^\s,;]+", re.I)
_HEX = re.compile(r"[0-9a-f]{32,}")
_IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
_IPV6 = re.compile(r"(?<![\w:.])[0-9A-Fa-f]{0,4}:[0-9A-Fa-f:]{2,36}[0-9A-Fa-f](?![\w:])")
_BORN = re.compile(r"(?:\bborn(?: on)?|\bdate of birth|\bDOB|\bgeboren am|\bnée? le|\bnacid[oa] el|\bдата рождения)[: ]{1,2}(\d{1,2}[./-]\d{1,2}[./-]\d{4}|\d{4}-\d{2}-\d{2})(?!\d)", re.I)
_STREET = "Street|St|Avenue|Ave|Road|Rd|Lane|Drive|Boulevard|Blvd|Square"
_ADDRESS = re.compile(
    rf"(?<![\w.,-])\d{{1,5}} (?:[A-Z][a-z'’-]+ ){{1,3}}(?:{_STREET})\b|\b[A-ZÄÖÜ][a-zäöüß]+(?:straße|strasse|gasse|platz|weg) \d{{1,4}}\b|(?<![\w.,-])\d{{1,4}},? (?:rue|boulevard|place|calle) (?:de |du |des |la |le |l'|d')*[A-ZÀ-Þ][\w-]+"
)
_FIXED = re.compile(rf"\b(?:{_STREET}|rue|boulevard|place|calle|de|du|des|la|le|l|d)\b|(?:straße|strasse|gasse|platz|weg)\b", re.I)
#: Numbers lie within runs of digits and what separates them; only these are looked at closely.
_RUN = re.compile(r"[+(\d][\d .()+-]{6,}")
_NUMBER = re.compile(
    r"(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d))"
    r"|(?P<card>(?<![\d-])(?:\d{4}[ -]?){3}\d{4}(?![\d-]))"
    r"|(?P<ssn>(?<![\d+.-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\d-]))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?\d{3}[ .-]?\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){3,4}(?!\d))"
)
_LISTED_NAME = re.compile(rf"\b(?P<given>{_NAME})\s+(?:[A-Z]\.\s+)?(?P<surname>{_WORD})")
_CUED_NAME = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(_CUES, key=len, reverse=True)))})\.?[ \t]+(?P<one>{_WORD})(?:[ \t]+(?:[A-Z]\.[ \t]+)?(?P<two>{_WORD}))?")
_NO_NAME = frozenset(STOP_WORDS.split()) | {x.lower() for x in _CUES} | set("all both everyone friends i it my our sirs there they this we you your".split())
_automaton: list[ahocorasick.Automaton] = []


def _hints(text: str) -> set[str]:
    """Whether a given name and whether a cue occurs, by one pass of an Aho-Corasick automaton."""
    if not _automaton:
        a = ahocorasick.Automaton()
        for cue in _CUES:
            a.add_word(cue, "cue")
        for names in GIVEN.values():
            for n in names:
                a.add_word(n, "name")
                a.add_word(n.upper(), "name")
        a.make_automaton()
        _automaton.append(a)
    out: set[str] = set()
    for _, hint in _automaton[0].iter(text):
        out.add(hint)
        if len(out) == 2:
            break
    return out


def _surname(word: str) -> bool:
    return len(word) > 1 and word.lower() not in _NO_NAME


def names(text: str) -> list[tuple[int, int, str]]:
    """(start, end, given or surname): whole names, and what they are made of wherever else it stands in the text."""
    hints = _hints(text)
    found: dict[tuple[int, int], str] = {}
    if "name" in hints:
        for m in _LISTED_NAME.finditer(text):
            if _surname(m["surname"]):
                found[m.span("given")], found[m.span("surname")] = "given", "surname"
    if "cue" in hints:
        for m in _CUED_NAME.finditer(text):
            one, two = m["one"], m["two"]
            if not _surname(one):
                continue
            both = two and _surname(two)
            found.setdefault(m.span("one"), "given" if both or one.lower() in _GIVEN else "surname")
            if both:
                found.setdefault(m.span("two"), "surname")
    if found:
        kinds = {text[i:j].lower(): kind for (i, j), kind in sorted(found.items())}
        forms = {f for i, j in found for w in [text[i:j]] for f in (w, w.upper(), w.title())}
        for m in re.finditer(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(forms, key=len, reverse=True))) + r")(?!\w)", text):
            found.setdefault(m.span(), kinds.get(m.group().lower(), "surname"))
    return sorted((i, j, kind) for (i, j), kind in found.items())


def _iban_valid(value: str) -> bool:
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _ipv6(value: str) -> ipaddress.IPv6Address | None:
    try:
        return ipaddress.IPv6Address(value) if value.count(":") > 2 and any(c.isdigit() for c in value) else None
    except ValueError:
        return None


def _date(value: str) -> tuple[datetime.date, str] | None:
    """The date and the order of its parts; of two readings day before month."""
    a, b, c = (int(x) for x in re.split(r"[./-]", value))
    for order, (y, m, d) in (("ymd", (a, b, c)), ("dmy", (c, b, a)), ("mdy", (c, a, b))):
        try:
            if (order == "ymd") == (a > 31) and 1900 <= y < 2100:
                return datetime.date(y, m, d), order
        except ValueError:
            pass
    return None


def entities(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind), from left to right; of overlapping ones the leftmost, then the first in the order below."""
    if not text:
        return []
    found: list[tuple[int, int, int, str]] = []
    if "@" in text:
        found += [(m.start(), 0, m.end(), "email") for m in _EMAIL.finditer(text)]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), "key") for m in _KEY.finditer(text)]
    if "assword=" in text or "ASSWORD=" in text:
        for m in _PASSWORD.finditer(text):
            value = m.group()
            found.append((m.start(), 2, m.start() + len(value.rstrip(".!?") or value), "password"))
    for m in _HEX.finditer(text):
        i, j = m.span()
        value = m.group()
        inside = i > 0 and (text[i - 1].isalnum() or text[i - 1] == "_") or j < len(text) and (text[j].isalnum() or text[j] == "_")
        if not inside and not value.isdigit() and not value.isalpha():
            found.append((i, 3, j, "token"))
    for m in _IBAN.finditer(text):
        for end in range(m.end(), m.start() + 14, -1):  # words of capitals may follow
            if (end == len(text) or not text[end].isalnum()) and text[end - 1] != " " and 15 <= len(v := text[m.start() : end].replace(" ", "")) <= 34 and _iban_valid(v):
                found.append((m.start(), 4, end, "iban"))
                break
    if ":" in text:
        found += [(m.start(), 5, m.end(), "ipv6") for m in _IPV6.finditer(text) if _ipv6(m.group())]
        found += [(m.start(1), 6, m.end(1), "born") for m in _BORN.finditer(text) if _date(m.group(1))]
    elif any(c in text for c in ("orn ", "oren am ", "ée le ", "é le ", "nacid", "OB ", "irth ", "рождения ")):
        found += [(m.start(1), 6, m.end(1), "born") for m in _BORN.finditer(text) if _date(m.group(1))]
    found += [(m.start(), 7, m.end(), "address") for m in _ADDRESS.finditer(text)]
    for run in _RUN.finditer(text):
        found += [(m.start(), 8, m.end(), m.lastgroup) for m in _NUMBER.finditer(text, run.start(), run.end())]
    found += [(i, 9, j, kind) for i, j, kind in names(text)]
    out, free = [], 0
    for i, _, j, kind in sorted(found):
        if i >= free:
            out.append((i, j, kind))
            free = j
    return out


def canonical(kind: str, value: str) -> str:
    """The form by which mentions of one entity are equal."""
    if kind in ("card", "phone", "ssn"):
        digits = "".join(c for c in value if c.isdigit())
        return digits[-10:] if kind == "phone" and len(digits) > 10 and not value.startswith("+") else digits
    if kind == "iban":
        return value.replace(" ", "")
    if kind == "ipv6":
        return _ipv6(value).exploded
    if kind == "born":
        return _date(value)[0].isoformat()
    return value if kind in ("key", "token", "password") else " ".join(value.lower().split())


_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: Vowels and consonants by script, plain and accented.
_LETTERS = (
    "aeiouy", "bcdfghjklmnpqrstvwxz", "àáâäãåèéêëìíîïòóôöõùúûü", "çñšžčř", "аеёиоуыэюя", "бвгджзклмнпрстфхцчшщ", "αεηιουω", "άέήίόύώ", "βγδζθκλμνξπρστφχψ", "0123456789",
)
_ENDING = re.compile(r"(?:ова|ева|ёва|ина|ская|цкая|ов|ев|ёв|ин|ский|цкий|ая|ий)$")
_DAYS = (datetime.date(1920, 1, 1).toordinal(), datetime.date(2010, 1, 1).toordinal())
_AREAS = [a for a in range(1, 900) if a != 666]


def _luhn_digit(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return -total % 10


class Surrogates:
    """The replacements that belong to a key."""

    def __init__(self, key: bytes):
        if not key:
            raise ValueError("surrogates need a secret key")
        self.key = key
        #: Each listed given name goes to the next in an order that depends on the key, so none stays.
        self.order = {k: sorted(range(len(ns)), key=lambda i, k=k: self._digest(f"given|{k}|{i}", 64)) for k, ns in GIVEN.items()}

    def _digest(self, what: str, bits: int) -> int:
        return int.from_bytes(hashlib.shake_256(self.key + b"|" + what.encode()).digest(bits // 8 + 1), "big")

    def permute(self, x: int, size: int, tweak: str) -> int:
        """A keyed permutation of range(size): a four-round Feistel network over the next even number of bits, walked until it falls back into the range."""
        if size < 2:
            return x
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        while True:
            left, right = x >> half, x & mask
            for r in range(4):
                left, right = right, left ^ (self._digest(f"{tweak}|{r}|{right}", half) & mask)
            x = left << half | right
            if x < size:
                return x

    def _shaped(self, value: str, tweak: str, alphabets: tuple[str, ...] = _CLASSES) -> str:
        """A permutation of the values that have this one's shape: each letter and digit keeps its class, all else stays."""
        shape, number, size = [], 0, 1
        for c in value:
            a = next((a for a in alphabets if c in a), None)
            shape.append(a or c)
            if a:
                number, size = number * len(a) + a.index(c), size * len(a)
        number = self.permute(number, size, f"{tweak}|{''.join(s if len(s) == 1 else str(len(s)) + s[0] for s in shape)}")
        out = []
        for s in reversed(shape):
            if len(s) > 1:
                number, d = divmod(number, len(s))
                out.append(s[d])
            else:
                out.append(s)
        return "".join(reversed(out))

    def surrogate(self, kind: str, value: str, attempt: int = 0) -> str:
        """The replacement of an entity in normal form, again in normal form."""
        made = self._made(kind, value, f"{kind}|{attempt}", attempt)
        return made if attempt < LAST or kind not in ("password", "given", "surname", "email", "address") else f"{made}{self._digest(f'{kind}|{attempt}|{value}', 40):x}"

    def _made(self, kind: str, value: str, tweak: str, attempt: int) -> str:
        if kind == "email":
            local, _, domain = value.partition("@")
            return f"{self._shaped(local, tweak + domain)}@{self._domain(domain, tweak)}"
        if kind == "ip":
            number = 0
            for part in value.split("."):
                number = number * 256 + int(part)
            number = self.permute(number, 1 << 32, tweak)
            return ".".join(str(number >> s & 255) for s in (24, 16, 8, 0))
        if kind == "ipv6":
            number = int(ipaddress.IPv6Address(value))  # the first group tells the address's kind
            return ipaddress.IPv6Address(number >> 112 << 112 | self.permute(number & (1 << 112) - 1, 1 << 112, tweak + str(number >> 112))).exploded
        if kind == "card":
            # The first digit tells the network; the check digit stays as valid as it was.
            body = value[0] + self._shaped(value[1:-1], tweak + value[0])
            return body + str((_luhn_digit(body) + int(value[-1]) - _luhn_digit(value[:-1])) % 10)
        if kind == "iban":
            body = self._shaped(value[4:], tweak + value[:2])
            rest = int("".join(str(int(c, 36)) for c in body + value[:2] + "00")) % 97
            return f"{value[:2]}{98 - rest:02}{body}"
        if kind == "ssn":
            number = (_AREAS.index(int(value[:3])) * 99 + int(value[3:5]) - 1) * 9999 + int(value[5:]) - 1
            number, serial = divmod(self.permute(number, len(_AREAS) * 99 * 9999, tweak), 9999)
            return f"{_AREAS[number // 99]:03}{number % 99 + 1:02}{serial + 1:04}"
        if kind == "born":
            day, (low, high) = datetime.date.fromisoformat(value).toordinal(), _DAYS
            if low <= day < high:
                return datetime.date.fromordinal(low + self.permute(day - low, high - low, tweak)).isoformat()
            year = 36525  # other dates move within their hundred years
            return datetime.date.fromordinal(day // year * year + self.permute(day % year, year, tweak + str(day // year))).isoformat()
        if kind == "phone":
            return value[:-10] + self._shaped(value[-10:], tweak + value[:-10]) if len(value) > 10 else self._shaped(value, tweak)
        if kind == "key":
            return "AKIA" + self._shaped(value[4:], tweak, (_CLASSES[2] + _CLASSES[0],))
        if kind == "token":
            return self._shaped(value, tweak, ("0123456789abcdef",))
        if kind == "given" and value in _GIVEN:
            own, i = _GIVEN[value]
            order = self.order[own]
            step = 1 + attempt % (len(order) - 1)
            return GIVEN[own][order[(order.index(i) + step) % len(order)]].lower()
        if kind in ("given", "surname"):
            end = _ENDING.search(value)
            stem = value[: end.start()] if end and end.start() > 1 else value
            return self._shaped(stem, tweak, _LETTERS) + value[len(stem) :]
        if kind == "address":
            parts, at = [], 0
            for m in [*_FIXED.finditer(value), None]:
                parts.append(self._shaped(value[at : m.start() if m else len(value)], f"{tweak}|{len(parts)}", _LETTERS))
                if m:
                    parts.append(m.group())
                    at = m.end()
            return "".join(parts)
        return self._shaped(value, tweak)

    def _domain(self, domain: str, tweak: str) -> str:
        """Another domain of the same shape below a reserved ending; addresses of one domain stay together."""
        labels = domain.split(".")
        if domain.endswith((".example.com", ".example.net", ".example.org")):
            return ".".join([*(self._shaped(x, tweak + "domain") for x in labels[:-2]), *labels[-2:]])
        return ".".join([*(self._shaped(x, tweak + "domain") for x in labels[:-1]), "example"])


@lru_cache(maxsize=8)
def keyed(key: bytes) -> Surrogates:
    return Surrogates(key)


def _worn(value: str, like: str, kind: str) -> str:
    """A surrogate in the format of the mention it replaces: its separators, and the case of its letters."""
    if kind in ("card", "phone", "ssn"):
        tail = iter(value[-sum(c.isdigit() for c in like) :])
        return "".join(next(tail) if c.isdigit() else c for c in like)
    if kind == "iban":
        rest = iter(value)
        return "".join(c if c == " " else next(rest) for c in like)
    if kind == "ipv6":
        out = ipaddress.IPv6Address(value).compressed
        return out.upper() if like.isupper() else out
    if kind == "born":
        order, parts = _date(like)[1], dict(zip("ymd", value.split("-")))
        marks, wide = re.findall(r"[./-]", like), [len(x) for x in re.split(r"[./-]", like)]
        new = [parts[o] if w > 1 else str(int(parts[o])) for o, w in zip(order, wide)]
        return f"{new[0]}{marks[0]}{new[1]}{marks[1]}{new[2]}"
    if kind in ("given", "surname"):
        return value.upper() if len(like) > 1 and like.isupper() else "-".join(x[:1].upper() + x[1:] for x in value.split("-"))
    if kind == "address":
        if len(value) != len(like):
            return value
        return "".join(v.upper() if c.isupper() else v for v, c in zip(value, like))
    if kind == "email":
        return value.upper() if like.isupper() else value
    return value


def _found(key: bytes):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = keyed(key)
        for b in batches:
            pairs = {(kind, canonical(kind, t[i:j])) for t in b.column(0).to_pylist() for i, j, kind in entities(t)}
            kinds, values = zip(*pairs) if pairs else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string()), pa.array([made.surrogate(k, v) for k, v in pairs], pa.string())], ["kind", "value", "surrogate"])

    return find


def collisions(docs: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, attempt) of the entities that can't take their first surrogate."""
    texts = docs.select(F.col("text").cast("string").alias("text"))
    table = kept(texts.mapInArrow(_found(key), "kind string, value string, surrogate string").distinct().withColumn("attempt", F.lit(0)), "entities")
    changed = table.limit(0)
    values = table.select("kind", F.col("value").alias("surrogate"))

    @F.udf("string", useArrow=True)
    def again(kind: str, value: str, attempt: int) -> str:
        return keyed(key).surrogate(kind, value, attempt)

    while True:
        # A listed given name's surrogate is by its nature a name of the list, so those are only held against one another.
        taken = table.join(values, ["kind", "surrogate"], "left_semi").filter("kind != 'given'")
        own = table.filter("surrogate = value")
        shared = table.groupBy("kind", "surrogate").agg(F.min("value").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        doubled = table.join(shared, ["kind", "surrogate"]).filter("value != first")
        bad = kept(taken.select("kind", "value", "attempt").unionByName(doubled.select("kind", "value", "attempt")).unionByName(own.select("kind", "value", "attempt")).distinct(), "collisions")
        if bad.isEmpty():
            break
        moved = bad.withColumn("attempt", F.col("attempt") + 1).withColumn("surrogate", again("kind", "value", "attempt"))
        table = kept(table.join(bad, ["kind", "value"], "left_anti").unionByName(moved.select(table.columns)), "entities")
        changed = table.filter("attempt > 0")
    return changed.select("kind", "value", "attempt")


def _mentioned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = {(key, kind, canonical(kind, t[i:j])) for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for i, j, kind in entities(t)}
        cols = zip(*rows) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string()))], ["key", "kind", "value"])


def _replace(key: bytes, attempts: dict[tuple[str, str], int]):
    """Rows (doc_id, text, further attempts of this text's entities or null) to their results."""

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, memo = keyed(key), {}
        for b in batches:
            texts, counts, own = b.column(1).to_pylist(), [], b.column(2).to_pylist()
            for row, t in enumerate(texts):
                found = entities(t)
                counts.append(len(found))
                if not found:
                    continue
                more = {(x["kind"], x["value"]): x["attempt"] for x in own[row] or ()}
                parts, at = [], 0
                for i, j, kind in found:
                    value = (kind, canonical(kind, t[i:j]))
                    known = (*value, more.get(value) or attempts.get(value, 0))
                    if known not in memo:
                        memo[known] = made.surrogate(*known)
                    parts += [t[at:i], _worn(memo[known], t[i:j], kind)]
                    at = j
                texts[row] = "".join([*parts, t[at:]])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], ["doc_id", "text", "n_entities"])
            if len(memo) > 200_000:
                memo.clear()

    return replace


def surrogates(docs: DataFrame, key: bytes, listed: int = LISTED) -> DataFrame:
    """(doc_id, text, n_entities) of every row, its entities replaced; who has the secret key can tell which surrogate is whose.

    Up to `listed` entities with a later attempt go to the tasks as a list; more of them are joined to the texts that
    mention them, by a hash of the text.
    """
    small_batches(docs.sparkSession)
    keyed(key)  # refuses an empty one
    changed = collisions(docs, key)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    few = changed.limit(listed + 1).collect()
    none = F.lit(None).cast("array<struct<kind:string,value:string,attempt:int>>").alias("more")
    if len(few) <= listed:
        attempts = {(r.kind, r.value): r.attempt for r in few}
        return rows.select("doc_id", "text", none).mapInArrow(_replace(key, attempts), RESULT)
    hashed = rows.withColumn("key", F.xxhash64("text"))
    mentions = hashed.select("key", "text").mapInArrow(_mentioned, "key long, kind string, value string").distinct()
    more = mentions.join(changed, ["kind", "value"]).groupBy("key").agg(F.collect_list(F.struct("kind", "value", "attempt")).alias("more"))
    return hashed.join(more, "key", "left").select("doc_id", "text", "more").mapInArrow(_replace(key, {}), RESULT)
