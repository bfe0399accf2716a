"""Personal information in free text: find it and put typed placeholders in its place.

Regular expressions propose spans; a span's score starts from how specific its pattern is, is
raised by validators (Luhn, mod-97, the letter of a mod-23 number, ISO 7064 mod 11,10, numbering
plans) and by context words, and lowered by words that name other numbers (tickets, parts,
orders). Spans that reach ``THRESHOLD`` count; of overlapping ones the higher score, then the
longer, wins. Everything is local to one text, so nothing is shuffled but the distinct items.

Defined results: null and empty texts hold nothing and stay as they are; metadata that isn't a
JSON object is treated as plain text; in metadata only string values are searched (their key is
context) and replaced, so keys, numbers and layout stay; texts are read whole; a null id is kept
in ``redact`` and left out of ``personal_items``; repeated rows give one row per distinct item;
other columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

THRESHOLD = 0.5
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}

_L = r"[^\W\d_][̀-ͯ]*"  # a letter with its combining marks
_W = rf"(?:{_L})+"
_S = r"[\s​⁠]"
_HY = r"[-‐-―−]"

# --- emails ------------------------------------------------------------------------------------
_AT = rf"(?:{_S}?[@＠]{_S}?|{_S}?[(\[{{]{_S}?(?:at|[@＠]){_S}?[)\]}}]{_S}?|{_S}at{_S})"
_DOT = rf"(?:\.|{_S}\.{_S}?|{_S}?[(\[{{]{_S}?(?:dot|\.){_S}?[)\]}}]{_S}?|{_S}dot{_S})"
_LOCAL = rf"(?:[\w%+][\w%+\-'̀-ͯ]*)(?:(?:\.|{_S}?[(\[]dot[)\]]{_S}?|{_S}dot{_S})[\w%+\-]+)*"
_EMAIL = re.compile(rf"(?<![\w@.])({_LOCAL})({_AT})(\w[\w\-]*(?:{_DOT}\w[\w\-]*)*{_DOT}[^\W\d_]{{2,24}})(?![\w@])", re.IGNORECASE)
_AT_DOMAIN = re.compile(rf"[\s(\[{{]at[\s)\]}}]\s?\w[\w\-]*(?:\.\w|{_S}?[(\[.]|{_S}dot\b)")
_MAIL_WORD = re.compile(r"(?:e-?mail|mail|reply|write|contact|address|cc|send)\W*(?:\w+\W+){0,2}$", re.IGNORECASE)

# --- phones ------------------------------------------------------------------------------------
_SEP = rf"(?:{_S}|{_HY}|[./])"
_PHONE = re.compile(
    rf"(?<![\w.,+\-/#@])(?:"
    rf"(?P<intl>(?:\+|00(?=[1-9]))[1-9]\d{{0,2}}{_SEP}?(?:\(0?\d{{1,4}}\){_SEP}?)?\d{{1,5}}(?:{_SEP}?\d{{2,5}}){{1,5}})|"
    rf"(?P<paren>\(\d{{2,5}}\){_S}?\d{{3,4}}(?:{_SEP}\d{{3,4}})?)|"
    rf"(?P<natl>0[1-9]\d{{1,4}}{_SEP}\d{{2,6}}(?:{_SEP}\d{{2,6}}){{0,3}})|"
    rf"(?P<nanp>(?:1{_SEP})?[2-9]\d{{2}}{_SEP}[2-9]\d{{2}}{_SEP}\d{{4}})|"
    rf"(?P<bare>0?[1-9]\d{{9,10}})"
    rf")(?!\w|[.,/]\d|{_HY}\w|@)"
)
_PHONE_WORD = re.compile(
    r"(?:\b(?:tele?phone|phone|tel|telefon|téléphone|teléfono|mobile|cell|cellular|handy|fax|whatsapp|call|ring|text|sms|dial|contact_no|contact|reach|left|on|hotline|number)\b)[^\d]{0,24}$",
    re.IGNORECASE,
)
_OTHER_NUMBER = re.compile(
    r"(?:\b(?:tickets?|orders?|parts?|invoices?|inv|batch(?:es)?|hash|tracking|code|build|rooms?|case|ref(?:erence)?|serial|lot|version|sku|item|product|model|shipment|parcel|package|incident|release|"
    r"account|meter|sensor|device|doc_id|session|session_id|transaction|booking|article|chapter|page|port|host|ip|bestellung|auftrag|teil|commande|pedido|factura|facture|rechnung)\b)"
    r"(?:\s+(?:no|nos|nr|num|number|numbers|code|id)\b)?[\s.:#=\"'(]*$",
    re.IGNORECASE,
)
_OTHER_AFTER = re.compile(r"^\W{0,3}(?:is out of stock|in stock|weighs|did not match|shows no scan|passed|is on its way|was paid)", re.IGNORECASE)

# --- identity numbers: the label says what it is ------------------------------------------------
_ID_LABEL = re.compile(
    r"(?<!\w)(?:ssn|social\s+security(?:\s+(?:number|no|nr|num|card))?|soc\.?\s*sec\.?(?:\s*(?:no|number))?|"
    r"(?:ni|nino|national\s+insurance)(?:\s+(?:number|no|nr))?|insurance\s+(?:number|no)|nhs\s+(?:number|no)|"
    r"dni|nie|nif|nss|curp|cpf|codice\s+fiscale|"
    r"(?:steuer|tax|fiscal)[-\s]*(?:id(?:entification)?|nummer|number|no|identifikationsnummer)(?:\s*(?:number|no))?|steuer-?idnr|tin|itin|numéro\s+fiscal|"
    r"personal\s+(?:number|no|id|code)|personalausweis(?:nummer)?|ausweis(?:nummer)?|(?:national\s+)?identity\s+(?:card|number|no|document)(?:\s+(?:number|no))?|id\s+card(?:\s+(?:number|no))?|national\s+id|carte\s+d['’]identité|"
    r"social(?=\W{1,4}\d{3}[\s\-]\d{2}[\s\-]\d{4})|passport(?:\s+(?:number|no|nr))?|reisepass(?:nummer)?|passeport|pasaporte|паспорт|"
    r"(?:driving|driver['’]?s?|driver)\s+licen[cs]e(?:\s+(?:number|no))?|licen[cs]e\s+(?:number|no)|führerschein(?:nummer)?|permis\s+de\s+conduire|permiso\s+de\s+conducir|sozialversicherungsnummer|versicherungsnummer)"
    r"(?![^\W_])\.?[\s\"':=#\-–(]*(?:is\s+|no\.?\s*|nr\.?\s*|№\s*)?[\"']?",
    re.IGNORECASE,
)
_ID_VALUE = re.compile(
    rf"[^\W\d_]{{2}}{_S}?\d{{2}}{_S}?\d{{2}}{_S}?\d{{2}}{_S}?[^\W\d_](?!\w)|\d{{3}}{_SEP}\d{{2}}{_SEP}\d{{4}}(?!\w)|\d{{8}}{_HY}?[^\W\d_](?!\w)|[xyz]{_HY}?\d{{7}}{_HY}?[a-z](?!\w)|"
    rf"[^\W\d_]\d{{3}}(?:{_HY}\d{{4}}){{2}}(?!\w)|\d{{2}}{_S}\d{{3}}{_S}\d{{3}}{_S}\d{{3}}(?!\w)|\d{{3}}{_S}\d{{3}}{_S}\d{{3,4}}(?!\w)|[^\W\d_]{{1,3}}{_S}?\d{{6,9}}[^\W\d_]?(?!\w)|"
    rf"\d{{9,14}}(?!\w)|(?=(?:[^\W\d_]*\d){{5}})[^\W_]{{2,6}}(?:[-./]?[^\W_]{{1,6}}){{1,5}}(?!\w)",
    re.IGNORECASE,
)
#: numbers without a label, by the scheme whose checksum can confirm them
_BARE_ID = re.compile(
    rf"(?<![\w.\-/])(?:(?P<mod23>\d{{8}}{_HY}?[A-Z]|[XYZ]{_HY}?\d{{7}}{_HY}?[A-Z])|(?P<nino>[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] ?\d{{2}} ?\d{{2}} ?\d{{2}} ?[A-D])|"
    rf"(?P<mod97>[12] ?\d{{2}} ?(?:0[1-9]|1[0-2]) ?\d{{2}} ?\d{{3}} ?\d{{3}} ?\d{{2}}|\d{{2}}\.(?:0\d|1[0-2])\.[0-3]\d-\d{{3}}\.\d{{2}})|"
    rf"(?P<mod11_10>[1-9]\d(?: ?\d{{3}}){{3}})|(?P<luhn>\d{{3}}[ \-]\d{{3}}[ \-]\d{{3}}))(?![\w\-])"
)
_ID_WORD = re.compile(r"\b(?:identity|identification|id|passport|licen[cs]e|insurance|social|tax|citizen|resident|national|holder|showed|document|doc_no|dni|nie|nif|ausweis|steuer|sécurité|sin)\b", re.IGNORECASE)


# --- addresses ----------------------------------------------------------------------------------
_COMMA = rf"{_S}*[,\n]{_S}*"
_GAP = rf"(?:{_COMMA}|{_S}+)"
_TOWN = rf"{_W}(?:['’\-]{_W})*(?:{_S}{_W}(?:['’\-]{_W})*){{0,3}}?"
_ZIP = rf"(?:\d{{5}}(?:-\d{{4}})?|[A-Z]{{1,2}}\d[A-Z\d]?{_S}?\d[A-Z]{{2}})(?!\w)"
_STREET_EN = r"(?:street|st|road|rd|avenue|ave|lane|ln|close|terrace|ter|drive|dr|court|ct|place|pl|way|boulevard|blvd|crescent|square|sq|hill|row|walk|gardens|grove|mews|parade|alley)"
_UNIT = r"(?:flat|apt|apartment|unit|suite|ste|floor|no)"
_NAME_WORDS = rf"{_W}(?:['’\-]{_W})*(?:{_S}+{_W}(?:['’\-]{_W})*){{0,3}}?"
_STOP = rf"(?={_S}*(?:$|[.;|,\n\"'}}\]!?)]))"
_EU_TOWN = rf"(?P<eu>{_W}(?:['’\-]{_W})*(?:{_S}{_W}(?:['’\-]{_W})*){{0,3}})"
_ADDRESS = [
    re.compile(
        rf"(?<![\w.\-/])(?:{_UNIT}\.?{_S}*\w{{1,5}}{_GAP})?\d{{1,5}}[a-z]?{_S}+{_NAME_WORDS}{_S}+{_STREET_EN}\b\.?(?:{_GAP}{_UNIT}\.?{_S}*#?\w{{1,5}})?{_GAP}(?:{_TOWN}(?:{_COMMA}|{_S}+){_ZIP}|(?P<town>{_TOWN}){_STOP})",
        re.IGNORECASE,
    ),
    re.compile(rf"(?<!\w)(?:p\.?{_S}?o\.?{_S}?box|post{_S}office{_S}box|postfach|boîte{_S}postale|apartado){_S}+\d{{1,6}}{_GAP}(?:{_TOWN}(?:{_COMMA}|{_S}+){_ZIP}|\d{{5}}{_S}+{_EU_TOWN})", re.IGNORECASE),
    re.compile(
        rf"(?<![\w\-])(?:{_W}(?:straße|strasse|str\.|gasse|weg|platz|allee|ring|ufer|damm|steig)|(?:am|an{_S}der|an{_S}den|im|in{_S}der|zum|zur|auf{_S}dem|auf{_S}der|unter{_S}den){_S}+{_W}){_S}+\d{{1,4}}{_S}?[a-z]?{_COMMA}\d{{5}}{_S}+{_EU_TOWN}",
        re.IGNORECASE,
    ),
    re.compile(
        rf"(?<![\w.\-])\d{{1,4}}(?:{_S}?(?:bis|ter|quater|[a-d]))?{_GAP}(?:rue|avenue|impasse|boulevard|place|chemin|allée|quai|cours|passage|route|square){_S}+[^\d,\n;|]{{2,50}}{_COMMA}\d{{5}}{_S}+{_EU_TOWN}",
        re.IGNORECASE,
    ),
    re.compile(
        rf"(?<![\w.\-])(?:calle|avenida|avda\.?|av\.|plaza|paseo|camino|carrera|ronda|travesía|c/){_S}+[^\d,\n;|]{{2,50}}{_S}+\d{{1,4}}(?:{_COMMA}\d{{1,3}}{_HY}?{_S}?[a-zº°]{{1,3}})?{_COMMA}\d{{5}}{_S}+{_EU_TOWN}",
        re.IGNORECASE,
    ),
]
#: literals, in lower case, of which every match of the expression at the same place holds one
_ADDRESS_HINTS = [
    (" street", " st", " road", " rd", " ave", " lane", " ln", " close", " ter", " dr", " court", " ct", " pl", " way", " boul", " blvd", " cresc", " sq", " hill", " row", " walk", " garden", " grove", " mews", " parade", " alley"),
    ("box", "postfach", "postale", "apartado"),
    ("stra", "str.", "gasse", "weg", "platz", "allee", "ring ", "ufer", "damm", "steig", "am ", "an d", "im ", "in der", "zum ", "zur ", "auf d", "unter d"),
    ("rue", "avenue", "impasse", "boulevard", "place", "chemin", "allée", "quai", "cours", "passage", "route", "square"),
    ("calle", "avenida", "avda", "av.", "plaza", "paseo", "camino", "carrera", "ronda", "travesía", "c/"),
]
_DIGIT = re.compile(r"\d")
_ADDRESS_WORD = re.compile(r"\b(?:home|address|addr|lives?|living|parcel|ship|deliver(?:y|ed)?|send|moved|resid\w+|at|to|wohnt|adresse|dirección|domicilio)\b\W{0,4}(?:\w+\W+)?$", re.IGNORECASE)
#: words that end a town in running text
_TOWN_END = frozenset("and or but is was has phone tel call for with on from until after before when if once because the a an this that keep ask it nothing".split())

# --- names --------------------------------------------------------------------------------------
# fixed values: name parts that are also everyday words, titles, particles
EVERYDAY = frozenset(
    """
    mark grant rose hazel dawn frost stone marsh reed will may june april august summer autumn faith hope joy grace
    iris ivy lily daisy violet ruby amber olive pearl jade coral heather holly rowan ash forest brook brooks lake field
    fields hill hills wood woods park parks rivers banks church bush berry rice snow winter winters day knight king bishop
    baker cook cooper carpenter fisher hunter mason miller porter potter smith taylor turner walker weaver young long
    short small little white black brown green gray grey bill bob jack art dale drew gene guy miles pat ray rob sandy skip
    """.split()
)
TITLES = frozenset("mr mrs ms miss mx dr prof professor sir dame lord lady herr frau monsieur madame mme mlle señor señora sr sra don doña rev fr".split())
PARTICLES = ("van der", "van den", "van de", "van", "von der", "von", "de la", "de las", "de los", "de", "del", "della", "di", "da", "dos", "du", "le", "la", "mc", "mac", "o", "al", "el", "bin", "ibn", "ten", "ter", "zu", "af", "st")
_H = r"[ \t\u00a0\u2000-\u200b\u202f\u3000]"  # blanks within a line
_PARTICLE = rf"(?:(?:{'|'.join(p.replace(' ', _H + '+') for p in PARTICLES)}){_H}+)?"
_PART = rf"(?:[OoDdLl]['’])?{_W}(?:[-‐‑’']{_W})*"
_INITIAL = rf"(?:{_L}\.{_H}?)"
_TITLE = rf"(?:(?<!\w)(?:{'|'.join(sorted(TITLES, key=len, reverse=True))})\b\.?{_H}+)"
_FULL = rf"(?:(?:{_INITIAL}{{1,3}}|{_PART}{_H}+(?:{_INITIAL}{{1,2}}{_H}*)?){_PARTICLE}{_PART})"
_REVERSED = rf"(?:{_PARTICLE}{_PART},{_H}+{_PART}(?:{_H}+{_L}\.(?={_H}|$))?)"
_FOLLOW = rf"(?={_H}*(?:$|[.;,|\n\"'}}\])!?]|{_H}(?:on|about|showed|asked|now|and|for|with|has|will|said|called|wrote|gave|at|to|or|from)\b))(?!{_H}*[:=])"
_CUE_WORDS = (
    r"(?:contact|guest|visitor|holder|signed(?:\s+by)?|call\s+back|called\s+back|belong(?:s|ing)?\s+to|spoke(?:n)?\s+with|met\s+with|meeting\s+with|attn|attention|full\s+name|owner|client|customer|patient|"
    r"employee|colleague|applicant|tenant|author|speaker|sender|recipient|reviewer|assignee|reported\s+by|requested\s+by|assigned\s+to|written\s+by|on\s+behalf\s+of|ask\s+for|dear|name)"
)
_CUE_AT = re.compile(rf"\b{_CUE_WORDS}\b[\"']?\s?[:=,]?{_H}*[\"']?", re.IGNORECASE)
_CUE = re.compile(rf"\b{_CUE_WORDS}\b[\s\"':=,\-–]*$", re.IGNORECASE)
_AFTER_WORDS = r"(?:asked\s+for|now\s+lives|lives\s+at|showed|phoned|is\s+waiting|has\s+asked|will\s+call|signed\s+for)\b"
_AFTER_AT = re.compile(rf"{_H}+{_AFTER_WORDS}", re.IGNORECASE)
_AFTER = re.compile(rf"^(?:\s*[,;]\s*(?=[\w.+\-]+\s?(?:[@＠]|\(at\)|\[at\]|at\s))|{_H}+(?:{_AFTER_WORDS}|about\s+it|on\s+(?=[+(\d])))", re.IGNORECASE)
_NAME_STOP = frozenset(
    """
    contact guest visitor holder signed call back belongs to spoke with the a an and or of in on at for by from home ring reply mail cc text tel phone
    ask keep nothing always never every last after before during when monday tuesday wednesday thursday friday saturday sunday it this that is was now
    ship ticket mention pin part room order hash batch code build sensor invoice project task item device route team due day mode tier showed asked
    lives about me us them him her you your my our their no not person name address email number details info information support sales service
    """.split()
)
#: last words of what is no person: teams, places, things
_NOT_A_PERSON = frozenset(
    """
    team desk staff crew guild squad group pod circle shift department office board committee company street road lane avenue depot hall annex wing mill
    room deck lab dock project release server page queue feed index list desk club school house bank shop store center centre form app view
    """.split()
)
_ANNOUNCED = re.compile(rf"(?P<title>{_TITLE})?(?:(?P<rev>{_REVERSED}){_FOLLOW}|(?P<full>{_FULL}){_FOLLOW}|(?P<one>{_PARTICLE}{_PART}){_FOLLOW})", re.IGNORECASE)
_ENDING = re.compile(rf"(?:^|[.;!?\n|:]{_H}*|\bvisitor{_H}+)(?P<title>{_TITLE})?(?:(?P<rev>{_REVERSED})|(?P<full>{_FULL})|(?P<one>{_PARTICLE}{_PART}))$", re.IGNORECASE)
_TITLED = re.compile(rf"{_TITLE}(?P<first>(?:{_INITIAL}{{1,3}}|{_PART}))(?P<second>{_H}+(?:{_INITIAL}{{1,2}}{_H}*)?{_PARTICLE}{_PART})?", re.IGNORECASE)
# words of which a text holds one wherever the expression they stand for can match
_PLAIN_WORD = re.compile(r"[^\W\d_]+")
_WORD_START = re.compile(rf"(?<![\w'’\u0300-\u036f]){_W}")
_WORD_MORE = re.compile(rf"[-‐‑'’ ]{_W}")
_IN_WORD = re.compile(r"[\w\u0300-\u036f]")
_CUE_HINTS = frozenset(
    "contact guest visitor holder signed call called belong belongs belonging spoke spoken met meeting attn attention full owner client customer patient employee colleague "
    "applicant tenant author speaker sender recipient reviewer assignee reported requested assigned written behalf ask dear name".split()
)
_AFTER_HINTS = frozenset("asked lives showed phoned waiting call signed".split())
_PARTICLE_WORDS = frozenset(w for p in PARTICLES for w in p.split())


def _fold(word: str) -> str:
    return unicodedata.normalize("NFC", word).casefold().replace("’", "'").replace("‑", "-").replace("‐", "-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = re.sub(r"\W", "", iban).upper()
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def mod23(number: str) -> bool:
    s = re.sub(r"\W", "", number).upper()
    s = {"X": "0", "Y": "1", "Z": "2"}.get(s[:1], s[:1]) + s[1:]  # a foreigner's number begins with a letter for a digit
    return s[:8].isdigit() and len(s) == 9 and "TRWAGMYFPDXBNJZSQVHLCKE"[int(s[:8]) % 23] == s[8]


def mod11_10(digits: str) -> bool:
    p = 10
    for d in digits[:-1]:
        s = (int(d) + p) % 10 or 10
        p = 2 * s % 11
    return (11 - p) % 10 == int(digits[-1])


def mod97_key(number: str) -> bool:
    """Social security numbers that end in 97 less the rest modulo 97 (of births from 2000 on, with a 2 before the rest)."""
    s = re.sub(r"\D", "", number)
    body, key = s[:-2], int(s[-2:])
    return any(97 - int(lead + body) % 97 == key for lead in (("", "2") if len(s) == 11 else ("",)))


def nino(number: str) -> bool:
    """National insurance numbers have no checksum, but prefixes that were never given out."""
    s = re.sub(r"\W", "", number).upper()
    return bool(re.fullmatch(r"[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z]\d{6}[A-D]", s)) and s[:2] not in ("BG", "GB", "KN", "NK", "NT", "TN", "ZZ")


VALIDATORS = {"mod23": mod23, "nino": nino, "mod97": mod97_key, "mod11_10": mod11_10, "luhn": luhn}


def valid_id(kind: str, value: str) -> bool:
    """Whether a number is one of the scheme ``kind``."""
    plain = re.sub(r"[\W_]", "", value)
    return VALIDATORS[kind](plain if kind in ("mod11_10", "luhn") else value)


def _emails(text: str) -> Iterator[tuple[int, int, str, float]]:
    for m in _EMAIL.finditer(text):
        local, at, domain = m[1], m[2], m[3]
        start = m.start()
        score = 0.9
        if at.strip().lower() == "at":
            written = re.search(r"\bdot\b", domain, re.IGNORECASE)
            handle = re.search(r"[\d._+\-]", local)
            asked = _MAIL_WORD.search(text, max(0, start - 40), start)
            score = 0.9 if written and (handle or asked) else 0.7 if written or handle and asked else 0.3
        elif at.strip() in "@＠" and at not in "@＠":
            score = 0.8
        if re.search(rf"{_S}\.{_S}|\.{_S}", domain) and not re.search(r"dot", domain, re.IGNORECASE):
            # "box . test": blanks around the point; a point at a sentence's end is no domain
            cut = re.match(rf"\w[\w\-]*(?:\.\w[\w\-]*)*\.[^\W\d_]{{2,24}}(?!\w)", domain)
            if cut and re.search(rf"[^{'.'}\s]\.{_S}", domain):
                yield start, m.start(3) + cut.end(), "email", score
                continue
        yield start, m.end(), "email", score


def _phones(text: str) -> Iterator[tuple[int, int, str, float]]:
    for m in _PHONE.finditer(text):
        digits = re.sub(r"\D", "", m[0])
        kind = m.lastgroup
        if not 9 <= len(digits) <= 15 and not (kind in ("paren", "natl") and len(digits) >= 8):
            continue
        score = {"intl": 0.7, "paren": 0.6, "natl": 0.5, "nanp": 0.5, "bare": 0.15}[kind]
        before = text[max(0, m.start() - 48) : m.start()]
        if _OTHER_NUMBER.search(before) or _OTHER_AFTER.search(text[m.end() : m.end() + 24]):
            score -= 0.6
        elif _PHONE_WORD.search(before):
            score += 0.4
        yield m.start(), m.end(), "phone", score


def _ids(text: str) -> Iterator[tuple[int, int, str, float]]:
    """A label that names an identity number is context enough, whatever its checksum: cards are mistyped, and schemes
    differ. Without a label a valid checksum and a word nearby that speaks of identity are needed, both of them."""
    for m in _ID_LABEL.finditer(text):
        v = _ID_VALUE.match(text, m.end())
        if v and sum(c.isdigit() for c in v[0]) >= 5:
            yield v.start(), v.end(), "id_number", 1.0
    for m in _BARE_ID.finditer(text):
        near = text[max(0, m.start() - 40) : m.start()]
        score = 0.2
        score += 0.25 if valid_id(m.lastgroup, m[0]) else -0.3
        score += 0.3 if _ID_WORD.search(near) else 0.0
        score -= 0.6 if _OTHER_NUMBER.search(near) or _OTHER_AFTER.search(text[m.end() : m.end() + 24]) else 0.0
        yield m.start(), m.end(), "id_number", score


def _trim_town(text: str, start: int, end: int) -> int:
    """Where a town that may have run into the sentence ends: at a word in lower case after one in upper."""
    words = list(re.finditer(rf"{_W}(?:['’\-]{_W})*", text[start:end]))
    keep = start + words[0].end() if words else end
    capital = words and words[0][0][0].isupper() and not words[0][0].isupper()
    for a, b in zip(words, words[1:]):
        w = b[0]
        if w.lower() in _TOWN_END or capital and not w[0].isupper() and w.lower() not in ("de", "la", "le", "les", "sur", "sous", "del", "am", "an", "der", "bei"):
            break
        keep = start + b.end()
    return keep


def _addresses(text: str, low: str) -> Iterator[tuple[int, int, str, float]]:
    for hints, pattern in zip(_ADDRESS_HINTS, _ADDRESS):
        for m in pattern.finditer(text) if any(h in low for h in hints) else ():
            end, score = m.end(), 0.9
            groups = m.groupdict()
            if groups.get("eu") is not None:
                end = _trim_town(text, m.start("eu"), m.end("eu"))
            elif groups.get("town") is not None:
                end = _trim_town(text, m.start("town"), m.end("town"))
                score = 0.35 + 0.2 * bool(re.search(rf"\b{_UNIT}\b", m[0], re.IGNORECASE))
                if _ADDRESS_WORD.search(text[max(0, m.start() - 40) : m.start()]):
                    score += 0.3
            yield m.start(), end, "address", score


class _Names:
    """Names around known parts, after titles, and in places where a name is announced."""

    def __init__(self, parts: dict[str, str]):
        self.parts = parts
        self.longest: dict[str, int] = {}  #: by first word, the words of the longest part
        for p in parts:
            words = _PLAIN_WORD.findall(p)
            if words:
                self.longest[words[0]] = max(self.longest.get(words[0], 1), len(words))
        self.hints = frozenset(self.longest)
        self.after = re.compile(rf"{_H}+(?:{_INITIAL}{{1,2}}{_H}*)?{_PARTICLE}(?P<part>{_PART})", re.IGNORECASE)
        self.comma = re.compile(rf",{_H}+(?P<part>{_PART})(?:{_H}+{_L}\.(?={_H}|$))?(?!{_H}*[:=])", re.IGNORECASE)
        self.before = re.compile(rf"(?:(?P<part>{_PART}){_H}+(?:{_INITIAL}{{1,2}}{_H}*)?|(?<!\w)(?P<ini>(?:{_L}\.{_H}?){{1,3}})){_PARTICLE}$", re.IGNORECASE)

    def kind(self, word: str) -> str | None:
        return self.parts.get(_fold(word))

    def spans(self, text: str) -> Iterator[tuple[int, int, str, float]]:
        words = set(_PLAIN_WORD.findall(_fold(text)))
        for m in _TITLED.finditer(text) if words & TITLES else ():
            yield from self._titled(m)
        for m in _CUE_AT.finditer(text) if words & _CUE_HINTS else ():
            n = _ANNOUNCED.match(text, m.end())
            if n:
                yield from self._announced(text, n, m.end())
        for m in _AFTER_AT.finditer(text) if words & _AFTER_HINTS else ():
            at = max(0, m.start() - 70)
            n = _ENDING.search(text[at : m.start()])
            if n:
                yield from self._announced(text, n, at, at)
        if words & self.hints:
            for start, end in self._known(text):
                yield from self._around(text, start, end)

    def _known(self, text: str) -> Iterator[tuple[int, int]]:
        """Where known parts stand: a look-up per word, whatever the number of parts; the longest part wins."""
        behind = 0
        for m in _WORD_START.finditer(text):
            most = self.longest.get(_fold(m[0])) if m.start() >= behind else None
            if most is None:
                continue
            ends = [m.end()]
            while len(ends) < most and (n := _WORD_MORE.match(text, ends[-1])):
                ends.append(n.end())
            for end in reversed(ends):
                if _fold(text[m.start() : end]) in self.parts and not _IN_WORD.match(text, end):
                    yield m.start(), end
                    behind = end
                    break

    def _titled(self, m: re.Match) -> Iterator[tuple[int, int, str, float]]:
        first, second = m["first"], m["second"]
        start = m.start("first")
        last = re.findall(_PART, second)[-1] if second else ""
        particle = _fold(first) in _PARTICLE_WORDS
        proper = second and (last[0].isupper() and (not last.isupper() or first.isupper()) or self.kind(last) is not None) and _fold(last) not in _NAME_STOP
        if proper and (first[0].isupper() or self.kind(first) or particle):
            yield start, m.end("second"), "name", 0.9
        elif not first.endswith(".") and not particle and (first[0].isupper() or self.kind(first)) and _fold(first) not in _NAME_STOP and len(first) > 1:
            yield start, m.end("first"), "name", 0.85

    def _announced(self, text: str, n: re.Match, at: int, offset: int = 0) -> Iterator[tuple[int, int, str, float]]:
        group = n.lastgroup if n.lastgroup in ("rev", "full", "one") else "one"
        name, start, end = n[group], n.start(group) + offset, n.end(group) + offset
        words = [w for w in re.findall(_PART, name) if len(w) > 1 and _fold(w) not in _PARTICLE_WORDS]
        if not words or any(_fold(w) in _NAME_STOP for w in words) or _fold(words[-1]) in _NOT_A_PERSON:
            return
        known = [self.kind(w) is not None for w in words]
        capital = all(w[0].isupper() for w in words)
        if group == "one":
            if n["title"] and (capital or known[0]):
                yield start, end, "name", 0.9
            return
        if group == "rev" and len(words) < 2:
            return
        lowered = all(w.islower() for w in words)
        if capital or lowered or any(known):
            yield start, end, "name", 0.75 + 0.1 * any(known) - 0.2 * (lowered and not any(known))

    def _around(self, text: str, start: int, end: int) -> Iterator[tuple[int, int, str, float]]:
        """Pairs with a known part: the other one known too, or written like a name."""
        own, kind = text[start:end], self.kind(text[start:end])
        everyday = _fold(own) in EVERYDAY
        a = self.after.match(text, end)
        if a:
            yield from self._pair(text, start, a.end(), own, a["part"], kind == "given")
        c = self.comma.match(text, end)
        if c and kind == "family" and self.kind(c["part"]) == "given" and not (everyday and _fold(c["part"]) in EVERYDAY and own.islower()):
            yield self._particled(text, start), c.end(), "name", 0.8
        at = max(0, start - 48)
        b = self.before.search(text[at : start])
        if not b or kind != "family":
            return
        if b["ini"] is not None:
            if b["ini"][0].isupper() == own[0].isupper() and not everyday:
                yield at + b.start(), end, "name", 0.75
        elif self.kind(b["part"]) is None:
            yield from self._pair(text, at + b.start("part"), end, own, b["part"], True)

    def _pair(self, text: str, start: int, end: int, own: str, other: str, likely: bool) -> Iterator[tuple[int, int, str, float]]:
        everyday = [w for w in (own, other) if _fold(w) in EVERYDAY]
        known = self.kind(other) is not None
        if not known and (not likely or _fold(other) in _NAME_STOP or _fold(other) in TITLES or _fold(other) in _NOT_A_PERSON or len(other) < 2):
            return
        told = _CUE.search(text, max(0, start - 40), start) is not None or _AFTER.match(text[end : end + 40]) is not None
        shouted = own.isupper() and other.isupper() or self._title_cased(text, start, end)
        capital = own[0].isupper() and other[0].isupper()
        if known and not everyday:
            yield start, end, "name", 0.85
        elif known and len(everyday) == 1 and (capital or told):
            yield start, end, "name", 0.75
        elif known and (told or capital and not shouted):
            yield start, end, "name", 0.6
        elif not known and (told and own[0].isupper() == other[0].isupper() or capital and not everyday and not shouted and own.isupper() == other.isupper()):
            yield start, end, "name", 0.65

    @staticmethod
    def _particled(text: str, start: int) -> int:
        b = re.search(rf"(?<!\w)(?:{'|'.join(p.replace(' ', _H + '+') for p in PARTICLES)}){_H}+$", text[max(0, start - 16) : start], re.IGNORECASE)
        return start - len(b[0]) if b else start

    @staticmethod
    def _title_cased(text: str, start: int, end: int) -> bool:
        """Whether the words around are capitalised as well, so that capitals say nothing."""
        near = re.findall(_W, text[max(0, start - 60) : start])[-5:] + re.findall(_W, text[end : end + 60])[:5]
        return len(near) > 2 and sum(w[0].isupper() for w in near) > 0.7 * len(near)


@lru_cache(maxsize=4)
def _names(parts: tuple[tuple[str, str], ...]) -> _Names:
    return _Names({_fold(p): k for p, k in parts})


def find(text: str, names: _Names) -> list[tuple[int, int, str]]:
    """Spans of personal items in ``text``, in order, not overlapping."""
    spans: list[tuple[int, int, str, float]] = []
    low = text.lower()
    if "@" in text or "＠" in text or "(at)" in low or "[at]" in low or _AT_DOMAIN.search(low):
        spans += _emails(text)
    digits = len(_DIGIT.findall(text))
    if digits >= 5:
        spans += _ids(text)
    if digits >= 8:
        spans += _phones(text)
    if digits >= 3:
        spans += _addresses(text, low)
    spans += names.spans(text)
    taken: list[tuple[int, int, str]] = []
    rank = {"email": 5, "id_number": 4, "address": 3, "phone": 2, "name": 1}
    for s, e, kind, score in sorted(spans, key=lambda x: (-(x[3] >= THRESHOLD), -rank[x[2]], -x[3], x[0] - x[1], x[0])):
        if score >= THRESHOLD and all(e <= a or s >= b for a, b, _ in taken):
            taken.append((s, e, kind))
    return sorted(taken)


def _squeeze(item: str) -> str:
    return "".join(c for c in item.lower() if c.isalnum())


def _replace(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for s, e, kind in spans:
        out += [text[at:s], PLACEHOLDER[kind]]
        at = e
    return "".join(out) + text[at:]


_JSON_STRING = re.compile(r'"(?:[^"\\]|\\.)*"')


def scan_metadata(raw: str, names: _Names) -> tuple[str, list[tuple[str, str]]]:
    """The metadata with items replaced, and the items; string values only, keys serve as context."""
    try:
        valid = isinstance(json.loads(raw), (dict, list))
    except (ValueError, RecursionError):
        valid = False
    if not valid:
        spans = find(raw, names)
        return _replace(raw, spans), [(k, _squeeze(raw[s:e])) for s, e, k in spans]
    out, items, at, key = [], [], 0, ""
    for m in _JSON_STRING.finditer(raw):
        if re.match(r"\s*:", raw[m.end() : m.end() + 8]):
            key = json.loads(m[0], strict=False)
            continue
        value = json.loads(m[0], strict=False)
        lead = key + ": "
        spans = [(s - len(lead), e - len(lead), k) for s, e, k in find(lead + value, names) if s >= len(lead)]
        if spans:
            items += [(k, _squeeze(value[s:e])) for s, e, k in spans]
            ascii_only = raw.isascii()
            out += [raw[at : m.start()], json.dumps(_replace(value, spans), ensure_ascii=ascii_only)]
            at = m.end()
    return "".join(out) + raw[at:], items


def scan_text(text: str, names: _Names) -> tuple[str, list[tuple[str, str]]]:
    spans = find(text, names)
    return _replace(text, spans), [(k, _squeeze(text[s:e])) for s, e, k in spans]


def _known_parts(name_parts: DataFrame, bound: int) -> tuple[tuple[str, str], ...]:
    """The parts as a tuple for the workers; the table is fixed and small, and its size is checked."""
    rows = name_parts.where("name_part IS NOT NULL AND trim(name_part) <> ''").select("name_part", "part_kind").distinct().limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"name_parts has more than {bound} rows")
    return tuple(sorted((r[0].strip(), (r[1] or "given").strip().lower()) for r in rows))


def personal_items(memories: DataFrame, name_parts: DataFrame, part_bound: int = 100_000) -> DataFrame:
    """``id, field_name, pii_type, item``: one distinct row per item."""
    parts = _known_parts(name_parts, part_bound)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = _names(parts)
        for b in batches:
            out = []
            for i, content, metadata in zip(b["id"], b["content"], b["metadata_json"]):
                if content:
                    out += [(i, "content", k, item) for k, item in scan_text(content, names)[1]]
                if metadata:
                    out += [(i, "metadata_json", k, item) for k, item in scan_metadata(metadata, names)[1]]
            yield pd.DataFrame(out, columns=["id", "field_name", "pii_type", "item"])

    rows = memories.where("id IS NOT NULL").select("id", "content", "metadata_json")
    found = rows.mapInPandas(scan, "id string, field_name string, pii_type string, item string")
    return found.where("item <> ''").distinct()


def redact(memories: DataFrame, name_parts: DataFrame, part_bound: int = 100_000) -> DataFrame:
    """``id, content, metadata_json, items``: both fields with placeholders, one row per input row."""
    parts = _known_parts(name_parts, part_bound)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = _names(parts)
        for b in batches:
            content = [scan_text(t, names) if t else (t, []) for t in b["content"]]
            metadata = [scan_metadata(t, names) if t else (t, []) for t in b["metadata_json"]]
            yield pd.DataFrame(
                {
                    "id": b["id"].to_numpy(),
                    "content": [c[0] for c in content],
                    "metadata_json": [m[0] for m in metadata],
                    "items": [len(c[1]) + len(m[1]) for c, m in zip(content, metadata)],
                }
            )

    return memories.select("id", "content", "metadata_json").mapInPandas(scan, "id string, content string, metadata_json string, items int")
