"""Problem 3: personal information in free text, replaced by typed placeholders.

E-mail addresses, phone numbers, identity numbers and street addresses are
found by their form. Names are found by what the corpus itself shows: words
that mostly follow listed given names are surnames, and words that mostly
stand before surnames are given names that the list lacks. Numbers and dates are
permuted within their format by a keyed Feistel network (`pseudonyms`), so that
equal values get equal stand-ins in every text, whatever their spelling.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import secrets
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import pseudonyms
from loomspan.runtime import checkpointed
from loomspan.tables import load

#: Setting that holds the key of the stand-ins; where it is unset, a key is drawn that nobody knows, for one application.
KEY_SETTING = "spark.loomspan.pii.key"
KEY = secrets.token_bytes(32)
#: Least share of a word's occurrences in which it stands beside the other part of a name.
NAME_SHARE = 0.2

# ---- forms ----------------------------------------------------------------

_AT = r"(?:@|＠|\s?[(\[{<]\s?(?:at|@|AT)\s?[)\]}>]\s?)"
_DOT = r"(?:\.|\s?[(\[{<]\s?(?:dot|\.|DOT|punkt|punto|point)\s?[)\]}>]\s?)"
_EMAIL = re.compile(rf"(?:mailto:)?(?<![\w.+-])[\w][\w.+'-]{{0,63}}{_AT}[\w-]{{1,63}}(?:{_DOT}[\w-]{{1,63}})*{_DOT}[A-Za-z]{{2,24}}(?![\w-])")
_AT_HINT = re.compile(r"at\s?[)\]}>]", re.IGNORECASE)
_EMAIL_WORDS = re.compile(r"(?<![\w.+-])(?:\w[\w+-]{0,63} (?:dot|DOT) )*\w[\w.+-]{0,63} (?:at|AT) [\w-]{1,63}(?: (?:dot|DOT) [\w-]{1,63})* (?:dot|DOT) [A-Za-z]{2,24}(?![\w-])")

_PHONE = re.compile(
    r"(?<![\w+.,/-])(?<!\d )(?:"
    r"\+[1-9]\d{0,2}(?:[ ./-]?\(0\))?(?:[ ./-]?\(?\d{1,11}\)?){1,6}"
    r"|00[1-9]\d{0,2}(?:[ ./-]\(?\d{2,4}\)?){3,5}"
    r"|(?:1[-. ])?\(\d{3}\) ?\d{3}[-. ]\d{4}"
    r"|(?:1[-. ])?\d{3}([-. ])\d{3}\1\d{4}"
    r"|0[1-9](?:([ .-])\d{2})(?:\2\d{2}){3}"
    r"|\(0\d{2,4}\) ?\d{3,4}[ -]?\d{2,4}"
    r"|0\d{2,4}[ /-]\d{3,4}[ -]\d{3,4}"
    r"|0\d{2,4}/\d{5,9}(?:-\d{1,4})?"
    r"|0\d{2,4} \d{5,9}-\d{1,4}"
    r")(?![\w])(?![.,/-]\d)(?! \d{2})(?:,? ?(?:ext\.?|x|Ext\.|extension|Durchwahl|poste) ?\d{1,5})?"
)

# Designations of national identity, passport, tax and social-insurance numbers.
DESIGNATIONS = [
    r"SSN", r"social[ -]security(?: (?:number|no\.?|nr\.?|#))?", r"national insurance(?: (?:number|no\.?|nr\.?))?", r"NI (?:number|no\.?)", r"NINO",
    r"passport(?: (?:number|no\.?|nr\.?|card))?", r"Reisepass(?:nummer|-?Nr\.?| Nr\.?)?", r"Pass(?:nummer|-Nr\.?)", r"passeport(?: (?:n[o°º]\.?|numéro))?", r"pasaporte(?: (?:n\.?[o°º]\.?|número))?",
    r"Personalausweis(?:nummer|-?Nr\.?| Nr\.?)?", r"Ausweis(?:nummer|-Nr\.?)", r"carte (?:nationale )?d['’]identité(?: n[o°º]\.?)?", r"identity (?:card|number|no\.?)(?: (?:number|no\.?))?", r"national id(?:entity)?(?: (?:card|number|no\.?))*", r"ID (?:card|number|no\.?)(?: (?:number|no\.?))?",
    r"documento nacional de identidad", r"Steuer-?(?:ID|Id|IdNr\.?|nummer|identifikationsnummer|Nr\.?)", r"tax (?:id(?:entification)?|number|no\.?|reference)(?: (?:number|no\.?))?", r"ITIN", r"TIN", r"EIN", r"UTR", r"numéro fiscal", r"número fiscal", r"Tax-ID",
    r"DNI", r"NIE", r"NIF", r"NIR", r"(?:numéro|n[o°º]\.?) de sécurité sociale", r"número de (?:la )?seguridad social", r"NUSS", r"NSS", r"Sozialversicherungs(?:nummer|-Nr\.?)", r"SV-(?:Nummer|Nr\.?)", r"Rentenversicherungsnummer", r"BSN", r"codice fiscale",
]
_ID = re.compile(rf"(?<![\w-])(?i:{'|'.join(DESIGNATIONS)})(?![\w])[\s:#=.\"']{{0,4}}(?:(?i:is|ist|est|es|lautet|number|no\.?|n[o°º]\.?|nr\.?)[\s:]{{1,2}})?(?P<value>[A-Z0-9](?:[ ./-]?[A-Z0-9]){{4,20}})(?![^\W_])")
_ID_ROOTS = (
    "ssn", "security", "insurance", "ni number", "ni no", "nino", "pass", "ausweis", "identi", "national id", "id card", "id number", "id no", "steuer", "tax", "tin", "ein", "utr", "fiscal", "dni", "nie", "nif", "nir", "sécurité", "seguridad", "nuss", "nss", "sozialvers", "sv-n", "rentenv", "bsn",
)

_UP = "A-ZÀ-ÖØ-Þ"
_CAP = rf"[{_UP}](?:[\w]|['’](?=[{_UP}a-z]))*"
_WS = r"(?: |\n|\r\n)"
_STREET_EN = re.compile(
    rf"(?:(?i:flat|apt\.?|apartment|unit|suite) \d{{1,4}}[A-Za-z]?,?{_WS})?(?<![\w.,-])\d{{1,4}}[A-Za-z]?{_WS}(?:{_CAP}{_WS}){{1,3}}"
    rf"(?:(?:Street|Road|Lane|Avenue|Court|Drive|Close|Way|Square|Place|Boulevard|Terrace|Row|Crescent|Gardens|Hill|Walk|Mews|Parade|Highway|Alley|Grove|Park"
    rf"|STREET|ROAD|LANE|AVENUE|COURT|DRIVE|CLOSE|WAY|SQUARE|PLACE|BOULEVARD|TERRACE|ROW|CRESCENT|GARDENS|HILL|WALK|MEWS|ALLEY|GROVE)(?![\w])|(?:St|Rd|Ln|Ave|Ct|Dr|Sq|Pl|Blvd|ST|RD|LN|AVE|CT|DR|BLVD)(?:\.|(?![\w])))"
)
_STREET_DE = re.compile(
    rf"(?<![\w])(?:[{_UP}][\w-]*(?:straße|strasse|str\.|weg|gasse|platz|allee|damm|ufer|steig|stieg|chaussee|straat|laan|gracht|plein|kade|STRASSE|STRAßE|STR\.|WEG|GASSE|PLATZ|ALLEE|DAMM|UFER)"
    rf"|[{_UP}][\w-]+[ -](?:Straße|Strasse|Str\.|Weg|Gasse|Platz|Allee|Damm|Ufer|Ring|STRASSE|STRAßE|WEG|PLATZ|ALLEE)){_WS}\d{{1,4}} ?[A-Za-z]?(?![\w])"
)
_DE_ROOTS = ("straße", "strasse", "str.", "weg", "gasse", "platz", "allee", "damm", "ufer", "steig", "stieg", "chaussee", "straat", "laan", "gracht", "plein", "kade", "ring")
_STREET_FR = re.compile(
    rf"(?<![\w.,-])\d{{1,4}}(?: ?(?:bis|ter|BIS|TER|[A-Da-d]))?,?{_WS}(?i:rue|avenue|av\.|boulevard|bd|bld|chemin|place|impasse|allée|quai|route|cours|square|passage|ruelle){_WS}"
    rf"(?:(?i:de la|de l['’]|de|des|du|d['’]|la|le|les){_WS}?)?(?:(?<=['’])|(?<=\s)){_CAP}(?:[- ]{_CAP})*"
)
_FR_ROOTS = ("rue", "aven", "av.", "boul", "bd", "bld", "chemin", "place", "impasse", "allée", "quai", "route", "cours", "square", "passage")
_STREET_ES = re.compile(
    rf"(?<![\w])(?:Calle|C/|Avda\.?|Avenida|Plaza|Paseo|Camino|Carrer|Ronda|Travesía|Callejón|CALLE|AVENIDA|PLAZA|PASEO|CAMINO) ?{_WS}?(?:(?i:del|de la|de los|de las|de|la|las|los){_WS})?{_CAP}(?:{_WS}(?:(?i:del|de la|de los|de las|de|y){_WS})?{_CAP}){{0,3}},?{_WS}(?:(?i:n\.?[º°o]\.?|núm\.?|número) ?)?\d{{1,4}}[A-Za-z]?(?:, \d{{1,2}}\.?[ºª](?: [A-Z])?)?"
)
_ES_ROOTS = ("calle", "c/", "avda", "avenida", "plaza", "paseo", "camino", "carrer", "ronda", "traves")

# Particles of surnames, and titles, which are no given names.
PARTICLES = ["van", "von", "vom", "de", "der", "den", "del", "la", "le", "du", "di", "da", "dos", "das", "zu", "zur", "ter", "ten", "af", "y", "el", "al", "bin", "ibn"]
TITLES = ["Mr", "Mrs", "Ms", "Miss", "Mx", "Dr", "Prof", "Professor", "Sir", "Madam", "Lord", "Lady", "Herr", "Frau", "Fräulein", "M", "Mme", "Mlle", "Monsieur", "Madame", "Señor", "Señora", "Señorita", "Sr", "Sra", "Srta", "Don", "Doña"]
_PARTS = "|".join([*PARTICLES, *[p.upper() for p in PARTICLES], *[p.capitalize() for p in ("van", "von", "de")]])
_WORD = rf"[{_UP}](?:[^\W\d_]|['’](?=[^\W\d_])){{1,30}}"
_PAIR = re.compile(rf"(?<![\w@.'’-])(?P<a>{_WORD})(?:(?P<comma>,)|(?:\s+[{_UP}]\.(?:[ -]?[{_UP}]\.)?)?(?:\s+(?:{_PARTS})){{0,3}})\s+(?=(?P<b>{_WORD}(?:-{_WORD})*)(?![\w@]))")
_PAIR_BARRELLED = re.compile(rf"(?<![\w@.'’-])(?P<a>{_WORD}-{_WORD}),\s+(?=(?P<b>{_WORD})(?![\w@]))")
_CAPITALISED = re.compile(rf"(?<![\w@.'’]){_WORD}")


@dataclass(frozen=True)
class Span:
    start: int
    end: int
    kind: str


def proper(word: str) -> str:
    """One spelling of a word written in capitals or not."""
    return word[:1].upper() + word[1:].lower()


def _digits(s: str) -> int:
    return sum(c.isdigit() for c in s)


# Kinds that problem 3 doesn't name; found on demand, and only where the value is valid.
_CARD = re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])")
_IBAN = re.compile(r"(?<![\w-])[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}(?![\w-])")
_BIRTH = re.compile(
    r"(?i:born(?: on)?|date of birth|DOB|geboren am|geb\.|Geburtsdatum|née? le|date de naissance|nacid[oa] el|fecha de nacimiento)[:\s]{1,3}(?P<value>\d{4}([-/.])\d{2}\2\d{2}|\d{2}([-/.])\d{2}\3\d{4})(?!\d)"
)
_MORE = {"payment_card": pseudonyms.payment_card, "iban": pseudonyms.iban, "birth_date": pseudonyms.date}


def more_spans(text: str) -> list[Span]:
    """Payment cards, bank accounts and dates of birth with right check digits."""
    out = [Span(m.start(), m.end(), "payment_card") for m in _CARD.finditer(text) if pseudonyms.payment_card(m[0], KEY)]
    out += [Span(m.start(), m.end(), "iban") for m in _IBAN.finditer(text) if pseudonyms.iban(m[0], KEY)]
    return out + [Span(m.start("value"), m.end("value"), "birth_date") for m in _BIRTH.finditer(text) if pseudonyms.date(m["value"], KEY)]


def form_spans(text: str, more: bool = False) -> list[Span]:
    """E-mail addresses, identity numbers, phone numbers and street addresses, without overlaps.

    more: payment cards, bank accounts and dates of birth as well.
    """
    out: list[Span] = more_spans(text) if more else []
    if "@" in text or "＠" in text:
        out += [Span(m.start(), m.end(), "email") for m in _EMAIL.finditer(text)]
    low = text.lower()
    if _AT_HINT.search(text):
        out += [Span(m.start(), m.end(), "email") for m in _EMAIL.finditer(text)]
    if " dot " in low and " at " in low:
        out += [Span(m.start(), m.end(), "email") for m in _EMAIL_WORDS.finditer(text)]
    if any(r in low for r in _ID_ROOTS):
        out += [Span(m.start("value"), m.end("value"), "id_number") for m in _ID.finditer(text) if _digits(m["value"]) >= 5]
    out += [Span(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= _digits(m[0]) <= 20]
    out += [Span(m.start(), m.end(), "street_address") for m in _STREET_EN.finditer(text)]
    if any(r in low for r in _DE_ROOTS):
        out += [Span(m.start(), m.end(), "street_address") for m in _STREET_DE.finditer(text)]
    if any(r in low for r in _FR_ROOTS):
        out += [Span(m.start(), m.end(), "street_address") for m in _STREET_FR.finditer(text)]
    if any(r in low for r in _ES_ROOTS):
        out += [Span(m.start(), m.end(), "street_address") for m in _STREET_ES.finditer(text)]
    return without_overlaps(out)


_ORDER = {k: i for i, k in enumerate(("iban", "payment_card", "birth_date", "email", "id_number", "phone", "street_address", "person_name"))}


def without_overlaps(spans: list[Span]) -> list[Span]:
    """In order of place; of overlapping spans the one of the surer kind, then the longer, stays."""
    kept: list[Span] = []
    for s in sorted(set(spans), key=lambda s: (_ORDER[s.kind], s.start - s.end, s.start)):
        if all(s.end <= k.start or k.end <= s.start for k in kept):
            kept.append(s)
    return sorted(kept, key=lambda s: s.start)


def name_pairs(text: str) -> list[tuple[str, str, bool, int, int]]:
    """(given, surname, sure, start, end) of all that might be a full name.

    Two neighbouring capitalised words are taken in both orders, with a comma
    only as surname, given. sure: may serve to learn names from.
    """
    out = []
    for m in _PAIR.finditer(text):
        a, b = proper(m["a"]), proper(m["b"].split("-")[0])
        end = m.end() + len(m["b"])
        if m["comma"]:
            out.append((proper(m["b"].split("-")[0]), a, False, m.start(), end))
        else:
            out += [(a, b, True, m.start(), end), (b, a, False, m.start(), end)]
    for m in _PAIR_BARRELLED.finditer(text):
        out.append((proper(m["b"]), proper(m["a"].split("-")[0]), False, m.start(), m.end() + len(m["b"])))
    return out


# ---- Feistel pseudonyms ----------------------------------------------------


def permuted_digits(digits: str, key: bytes = KEY, rounds: int = 10) -> str:
    """A keyed permutation of the digit strings of one length (two digits at least); others stay."""
    n = len(digits)
    if n < 2:
        return digits
    half = n // 2
    a, b = digits[:half], digits[half:]
    for r in range(rounds):
        mac = int.from_bytes(hmac.new(key, f"{n}:{r}:{b}".encode(), hashlib.sha256).digest()[:16], "big")
        a, b = b, str((int(a) + mac) % 10 ** len(a)).zfill(len(a))
    return a + b


def restored_digits(digits: str, key: bytes = KEY, rounds: int = 10) -> str:
    """The inverse of permuted_digits."""
    n = len(digits)
    if n < 2:
        return digits
    # halves swap in every round, so after an even number they lie as at first
    half = n // 2 if rounds % 2 == 0 else n - n // 2
    a, b = digits[:half], digits[half:]
    for r in reversed(range(rounds)):
        mac = int.from_bytes(hmac.new(key, f"{n}:{r}:{a}".encode(), hashlib.sha256).digest()[:16], "big")
        a, b = str((int(b) - mac) % 10 ** len(b)).zfill(len(b)), a
    return a + b


_DNI_LETTERS = pseudonyms.DNI_LETTERS


def _bare_email(value: str) -> str:
    """One spelling of an address, disguised or not."""
    plain = re.sub(r"^mailto:", "", value)
    plain = re.sub(rf"{_AT}| at ", "@", plain, flags=re.IGNORECASE)
    return re.sub(rf"{_DOT}| dot ", ".", plain, flags=re.IGNORECASE).casefold()


def pseudonym(value: str, kind: str, key: bytes = KEY) -> str:
    """A stand-in for a value: numbers and dates in their own format, other kinds as a short keyed tag."""
    if kind == "phone":
        return pseudonyms.phone_number(value, key)
    if kind == "id_number":
        return pseudonyms.identity_number(value, key)
    if kind in _MORE:
        return _MORE[kind](value, key) or ""
    plain = _bare_email(value) if kind == "email" else re.sub(r"\s+", " ", value).strip().casefold()
    return hmac.new(key, f"{kind}:{plain}".encode(), hashlib.sha256).hexdigest()[:8]


def redacted(text: str, spans: list[Span], key: bytes = KEY) -> str:
    """The text with [KIND stand-in] for each span and all else unchanged."""
    out, at = [], 0
    for s in spans:
        out += [text[at : s.start], f"[{s.kind.upper()} {pseudonym(text[s.start : s.end], s.kind, key)}]"]
        at = s.end
    return "".join(out) + text[at:]


# ---- Spark -----------------------------------------------------------------

_SCAN = "record_table string, record_id string, pii_type string, given string, surname string, sure boolean, n long"


def scan(texts: DataFrame) -> DataFrame:
    """One pass over (record_table, record_id, content).

    Rows (kind found) for each record and kind; rows of kind person_name with
    the two words of what might be a name; and for each partition the number of
    occurrences of each capitalised word (kind null, word in surname, n).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter[str] = Counter()
        columns = ["record_table", "record_id", "pii_type", "given", "surname", "sure", "n"]
        for pdf in batches:
            rows = []
            for table, record, text in zip(pdf["record_table"], pdf["record_id"], pdf["content"]):
                words.update(map(proper, _CAPITALISED.findall(text)))
                rows += [(table, record, kind, None, None, None, 1) for kind in {s.kind for s in form_spans(text)}]
                rows += [(table, record, "person_name", g, s, sure, n) for (g, s, sure), n in Counter(p[:3] for p in name_pairs(text)).items()]
            yield pd.DataFrame(rows, columns=columns)
            if len(words) > 200_000:
                yield pd.DataFrame([(None, None, None, None, w, None, n) for w, n in words.items()], columns=columns)
                words.clear()
        yield pd.DataFrame([(None, None, None, None, w, None, n) for w, n in words.items()], columns=columns)

    return texts.filter("content is not null").mapInPandas(run, _SCAN)


def learned_names(scanned: DataFrame, given_names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(surname) and (given), learned from word counts over all texts.

    A surname follows listed given names in NAME_SHARE of its occurrences; a
    given name is listed or stands before surnames in NAME_SHARE of its own.
    Both stay distributed tables: they grow with the corpus.
    """
    listed = given_names.select(F.initcap(F.lower(F.trim("given_name"))).alias("given")).filter("given <> ''").distinct()
    total = scanned.filter("pii_type is null").groupBy(F.col("surname").alias("word")).agg(F.sum("n").alias("total"))
    pairs = scanned.filter("pii_type = 'person_name' and sure").groupBy("given", "surname").agg(F.sum("n").alias("n"))
    after = pairs.join(listed, "given", "left_semi").groupBy("surname").agg(F.sum("n").alias("n"))
    # no given name: a listed one may follow another, as in "Amber Reed"
    surnames = after.join(total, F.col("surname") == F.col("word")).filter(F.col("n") >= NAME_SHARE * F.col("total")).select("surname").join(listed.withColumnRenamed("given", "surname"), "surname", "left_anti")
    before = pairs.join(surnames, "surname", "left_semi").groupBy("given").agg(F.sum("n").alias("n"))
    others = before.join(total, F.col("given") == F.col("word")).filter((F.col("n") >= NAME_SHARE * F.col("total")) & ~F.col("given").isin(TITLES)).select("given")
    return surnames, listed.unionByName(others).distinct()


def record_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [load(spark, sf_dir, t).select(F.lit(t).alias("record_table"), F.col("id").alias("record_id"), "content") for t in ("drawers", "diary_entries")]
    return parts[0].unionByName(parts[1])


def _confirmed(scanned: DataFrame, given_names: DataFrame) -> DataFrame:
    """Rows of `scanned` whose two words are a given name and a surname."""
    surnames, given = learned_names(scanned, given_names)
    return scanned.filter("pii_type = 'person_name'").join(surnames, "surname", "left_semi").join(given, "given", "left_semi")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_table, record_id, pii_type): the kinds that occur in each record."""
    scanned = checkpointed(scan(record_texts(spark, sf_dir)))
    names = _confirmed(scanned, load(spark, sf_dir, "given_names"))
    columns = ["record_table", "record_id", "pii_type"]
    return scanned.filter("pii_type <> 'person_name'").select(*columns).unionByName(names.select(*columns)).dropDuplicates()


def key_of(spark: SparkSession) -> bytes:
    """The session's key of the stand-ins."""
    own = spark.conf.get(KEY_SETTING, None)
    return own.encode() if own else KEY


def p3_redacted(spark: SparkSession, sf_dir: str, key: bytes | None = None, more: bool = False) -> DataFrame:
    """(record_table, record_id, content): every text with placeholders; null contents stay null.

    key: of the stand-ins, the session's by default. more: see form_spans.
    Texts are shuffled once, by their record, to meet its names and to leave
    repeated rows out.
    """
    key = key or key_of(spark)
    texts = record_texts(spark, sf_dir)
    scanned = checkpointed(scan(texts))
    names = _confirmed(scanned, load(spark, sf_dir, "given_names"))
    own = names.groupBy("record_table", "record_id").agg(F.collect_set(F.struct("given", "surname")).alias("names"))  # names of one record
    # repeated rows go once they lie with their record's names, so texts aren't shuffled for them
    joined = texts.join(own, ["record_table", "record_id"], "left").dropDuplicates(["record_table", "record_id", "content"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, known in zip(pdf["content"], pdf["names"]):
                if text is None:
                    out.append(None)
                    continue
                spans = form_spans(text, more)
                if known is not None:
                    pairs = {(n["given"], n["surname"]) for n in known}
                    spans = without_overlaps(spans + [Span(a, b, "person_name") for g, s, _, a, b in name_pairs(text) if (g, s) in pairs])
                out.append(redacted(text, spans, key))
            yield pd.DataFrame({"record_table": pdf["record_table"], "record_id": pdf["record_id"], "content": out})

    return joined.mapInPandas(run, "record_table string, record_id string, content string")
