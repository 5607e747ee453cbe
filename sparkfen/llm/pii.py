"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Offsets are code points, the end exclusive. email, ip, card and phone are decided by their pattern and check alone and
get a score for use downstream. The others need a score of min_score: iban (length of its country, mod 97), national_id
(three-two-four digits; eight digits with a check letter; fifteen digits with a mod-97 key) and secret (a value assigned
to a name that says so, or of a known form, with the entropy of a random one).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfen.llm.common import annotate

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "national_id", "secret")
KINDS = (*BASE_KINDS, *ADDED_KINDS)
#: The score of a confirmed span by kind, and the words (English, German, French, Spanish) that raise or
#: lower it within NEAR characters.
PRIOR = {"email": 0.95, "ip": 0.6, "card": 0.8, "phone": 0.8, "iban": 0.7, "national_id": 0.35, "secret": 0.6}
RAISING = {
    "email": frozenset("mail email contact kontakt courriel correo".split()),
    "ip": frozenset("ip host server address adresse serveur servidor".split()),
    "card": frozenset("card visa credit payment karte kreditkarte carte tarjeta pago".split()),
    "phone": frozenset("phone call tel mobile telefon anruf handy téléphone teléfono móvil".split()),
    "iban": frozenset("iban account bank konto überweisung compte banque virement cuenta banco transferencia".split()),
    "national_id": frozenset("ssn social security identity tax sozialversicherung steuer ausweis sécurité sociale identité nir dni nif documento identidad seguridad".split()),
    "secret": frozenset("token secret password key credential passwort kennwort schlüssel secrète clé contraseña clave".split()),
}
LOWERING = {
    "email": frozenset(), "ip": frozenset(("version", "release")), "card": frozenset(("order", "isbn", "serial")), "phone": frozenset(("fax",)),
    "iban": frozenset("serial part order seriennummer bestellung série commande serie pedido".split()),
    "national_id": frozenset("part serial order seriennummer bestellung série commande serie pedido".split()),
    "secret": frozenset("example checksum sha1 sha256 md5 commit revision beispiel exemple ejemplo".split()),
}
NEAR = 40
#: The length of an account number by country.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20,
    "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30,
    "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24,
    "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22,
    "VG": 24, "XK": 20,
}
#: The check letter of eight digits, by their remainder modulo 23.
CHECK_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
#: Forms of issued keys.
ISSUED = (("AKIA", re.compile(r"AKIA[0-9A-Z]{16}")), ("gh", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}")), ("xox", re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}")), ("PRIVATE KEY-----", re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")))

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?=[\x20]?[A-Z0-9])")
TAIL = re.compile(r"[\x20]?[A-Z0-9]")
NATIONAL = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")
LETTERED = re.compile(r"[0-9]{8}-?[A-Z]")
KEYED = re.compile(r"[12][0-9]{14}")
ASSIGNED = re.compile(r"[:=][\x20\t]*[\"']?([A-Za-z0-9+/_.=-]{16,})")
NAMED = re.compile(r"(?:token|secret|passw(?:or)?d|passwort|pwd|credential|bearer|auth|api[_ -]?key|access[_ -]?key|private[_ -]?key)[\"'\x20\t_A-Za-z0-9-]{0,16}$", re.I)
WORD = re.compile(r"[^\W\d_]+|sha1|sha256|md5")


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an account number's check digits are right."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Found from each @ outwards, so that a long run without one costs nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Runs of dotted numbers, cut into fours from the left."""
    for m in DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        numbers, at = m[0].split("."), m.start()
        for k in range(0, len(numbers) - 3, 4):
            four = numbers[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in four):
                yield at, end
            at = end + 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    """Chains of 13 to 19 digits that pass Luhn."""
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    """International numbers of 9 to 15 digits."""
    at = text.find("+")
    while at >= 0:
        m = PHONE.match(text, at)
        if m and 9 <= len(_digits(m[0])) <= 15:
            yield m.span()
        at = text.find("+", m.end() if m else at + 1)


def _alone(text: str, start: int, end: int) -> bool:
    return not (start and (text[start - 1].isalnum() or text[start - 1] == "-")) and not (end < len(text) and (text[end].isalnum() or text[end] == "-"))


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers of their country's length, in groups or not, that pass mod 97."""
    for m in IBAN.finditer(text):
        length, at, n = IBAN_LENGTH.get(m[0][:2], 0), m.end(), 4
        while n < length and (t := TAIL.match(text, at)):
            at, n = t.end(), n + 1
        if n == length and _alone(text, m.start(), at) and mod97(text[m.start() : at].replace(" ", "")):
            yield m.start(), at


def national_ids(text: str) -> Iterator[tuple[int, int]]:
    """Three, two and four digits, none of them all zero; and numbers with a check letter or key."""
    found = [m.span() for m in NATIONAL.finditer(text) if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000"]
    found += [m.span() for m in LETTERED.finditer(text) if CHECK_LETTERS[int(m[0][:8]) % 23] == m[0][-1]]
    found += [m.span() for m in KEYED.finditer(text) if 97 - int(m[0][:13]) % 97 == int(m[0][13:])]
    yield from sorted(s for s in found if _alone(text, *s))


def _random(value: str) -> bool:
    """Whether a text has letters and digits, and at least three bits a character."""
    counts = Counter(value)
    bits = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    return bits >= 3 and any("0" <= c <= "9" for c in counts) and any(c.isalpha() for c in counts)


def secrets(text: str) -> Iterator[tuple[int, int]]:
    """Values of at least 16 characters assigned to a telling name, and issued keys."""
    found = {m.span(1) for m in ASSIGNED.finditer(text) if _random(m[1]) and NAMED.search(text, max(0, m.start() - 48), m.start())}
    for sign, form in ISSUED:
        if sign in text:
            found |= {m.span() for m in form.finditer(text)}
    done = 0
    for start, end in sorted(found):
        if start >= done:
            yield start, end
            done = end


FINDERS = {"email": emails, "ip": ips, "card": cards, "phone": phones, "iban": ibans, "national_id": national_ids, "secret": secrets}


def score(text: str, kind: str, start: int, end: int) -> float:
    """The kind's prior, 0.3 more or less for words nearby, within 0 and 1."""
    near = set(WORD.findall(f"{text[max(0, start - NEAR) : start]} {text[end : end + NEAR]}".lower()))
    return max(0.0, min(1.0, PRIOR[kind] + 0.3 * (not near.isdisjoint(RAISING[kind])) - 0.3 * (not near.isdisjoint(LOWERING[kind]))))


def find(text: str | None, min_score: float = 0.5) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of a text, by kind in the order of KINDS, then start; a missing text has none."""
    out = []
    if not text:
        return out
    for kind in KINDS:
        for start, end in FINDERS[kind](text):
            s = score(text, kind, start, end)
            if kind in BASE_KINDS or s >= min_score:
                out.append((kind, start, end, s))
    return out


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])


def find_pii(df: DataFrame, text: str = "text", min_score: float = 0.5, redact: bool = False) -> DataFrame:
    """df with pii_spans (array of kind, start, end, score) and, with redact, redacted (the text with [KIND] for spans).

    A missing or empty text has no spans and redacts to itself. Columns of df with these names are replaced; repeated
    rows are treated alike. Whole texts are read, each search is linear in the text, and rows stay where they are. Where spans overlap the redaction takes the first, then the longer.
    """
    fields = [T.StructField("pii_spans", T.ArrayType(SPAN))] + [T.StructField("redacted", T.StringType())] * redact

    def start():
        def work(batch: pa.RecordBatch) -> list:
            texts = batch.column(batch.schema.get_field_index("__text")).to_pylist()
            found = [find(t, min_score) for t in texts]
            spans = [[dict(zip(("kind", "start", "end", "score"), s)) for s in x] for x in found]
            return [spans, [cover(t, x) for t, x in zip(texts, found)]] if redact else [spans]

        return work

    return annotate(df.withColumn("__text", F.col(f"`{text}`")), fields, start).drop("__text")


def cover(text: str | None, spans: list[tuple[str, int, int, float]]) -> str | None:
    """The text with the spans replaced."""
    if not text:
        return text
    out, done = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
            done = end
    return "".join([*out, text[done:]])


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the query over documents."""
    spans = find_pii(docs.select("doc_id", "text")).drop("text")
    joined = lambda of: F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("pii_spans", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("pii_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    more = [*[count(k) for k in ADDED_KINDS], F.size("pii_spans").cast("long").alias("n_spans")]
    return spans.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii_spans")).alias("spans"), *more)
