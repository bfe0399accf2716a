"""Template residue and error-page text.

Detects, in whole texts: unfilled placeholders (a grammar per delimiter), filler text, error
messages of sites and programs, and notices that scripts must be allowed. For
placeholders, code blocks that are closed are taken out first. A placeholder in a sentence that explains template syntax is a tutorial, unless the
sentence carries more placeholders than an example would; words that merely name such things
(an error found in a ledger, a course on scripting, prices in [brackets], a set {1, 2, 3}) match
none of the grammars.

Defined results: a null or blank text has no residue; a null doc_id is carried along in the flags
and left out of ``residue_documents``; repeated rows give one row per distinct doc_id there; an
empty table gives no rows; other columns are ignored. Texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("placeholder", "filler", "error", "scripts")

# --- fixed values: words that name a field to be filled in -------------------------------------
FIELD_WORDS = frozenset(
    """
    name firstname lastname surname fullname username user customer client company product title date city town
    country address street amount price total sum order number recipient sender email mail phone subject topic brand
    url link text headline day month year time place position department signature product_name
    vorname nachname name firmenname firma kunde kundenname datum stadt ort betrag titel empfänger anrede produkt
    nom prénom client entreprise société ville montant titre produit destinataire adresse
    nombre apellido empresa fecha ciudad importe título producto destinatario cliente
    имя фамилия отчество компания город дата сумма название получатель клиент товар
    """.split()
)
HTML_TAGS = frozenset(
    """
    a abbr address article aside b big blockquote body br button caption center code col dd del details dfn div dl dt em
    fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label
    legend li link main mark menu meta nav noscript object ol option p param picture pre q s samp script section select
    small source span strike strong style sub summary sup svg table tbody td textarea tfoot th thead time tr tt u ul
    var video audio canvas template
    """.split()
)
LATIN_FILLER = frozenset(
    """
    lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua
    enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure
    reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident culpa
    officia deserunt mollit anim laborum
    """.split()
)

_ID = r"[^\W\d]\w*(?:[.\-]\w+|\[\d+\])*"
_PLACEHOLDERS = re.compile(
    "|".join(
        [
            rf"\{{\{{\{{?\s*[#/^>&]?\s*{_ID}(?:\s*\|\s*\w+)*\s*\}}\}}\}}?",
            r"\{%-?\s*[^{}%\n]{1,80}?\s*-?%\}",
            r"<%[=\-]?\s*[^<>%\n]{1,80}?\s*-?%>",
            rf"[$#]\{{\s*{_ID}\s*\}}",
            rf"\[\[\s*{_ID}\s*\]\]",
            rf"<<\s*{_ID}\s*>>",
            rf"@@\s*{_ID}\s*@@",
            rf"(?<![\w]){'_' * 2}[^\W\d_](?:\w*[^\W_])?(?:[.\-]\w+|\[\d+\])*{'_' * 2}(?![\w])",
            rf"(?<![\w%])%{_ID}%(?!\w)",
            rf"(?<![\w$])\${_ID}\$(?!\w)",
            rf"(?<![{{$#\\\w])\{{\s*(?:\d{{1,2}}|[^\W\d]\w+(?:[.\-]\w+|\[\d+\])*)\s*\}}(?!\}})",
            rf"&lt;\s*{_ID}\s*&gt;",
            r"\[\s*(?:insert|enter|add|your|einf(?:ü|ue)gen|ins(?:é|e)rer|insertar|вставьте)\b[^\[\]\n]{0,60}(?:\[\d+\][^\[\]\n]{0,40})?\]",
            r"\[\s*(?:TBD|TODO|TBA|TBC|FIXME|XXX+|N\.N\.|\.\.\.|…)?\s*\](?!\()",
            r"\[object Object\]",
            r"(?<![\w])[Xx]{4,}(?![\w])",
            r"(?<![\w])_{4,}(?![\w])",
            r"(?<![\w%])%(?:\d+\$)?(?:0?\d*\.?\d*)[sdif@](?!\w)",
            r"(?<!\bis )(?<!\bare )(?<!\bwas )(?<!\bwere )(?<!\bbe )(?<!\ban )(?<!\bto )(?<!\bleft )(?<!\bremains )(?<!\bthe )(?<!\bsome )(?<!\bof )(?<!\bwith )(?-i:\bundefined\b)(?! (?:function|method|behaviou?r|variable|index|offset|property))",
            r"\b(?:dear|hello|hi|regards|bonjour|estimado/a|hallo|arrives? on|parcel)\W{1,3}(?:undefined|null|NaN|None)\b",
            r"\b(?:arrives on|kommt am|arrive le|llega el)\s+(?:undefined|null|NaN|None)\b",
        ]
    ),
    re.IGNORECASE,
)
_BRACKETED = re.compile(rf"\[\s*({_ID}(?: {_ID}){{0,2}})\s*\](?!\()|(?<![<\w])<\s*({_ID})\s*>(?!>)")
_GREETING = re.compile(r"(?:dear|hello|hi|regards|sincerely|sehr geehrte/?r?|mit gru(?:ß|ss)|bonjour|bien à vous|estimado/?a?|atentamente|здравствуйте|с уважением)\W{0,3}$", re.IGNORECASE)
_CODE_START = re.compile(r"(```)|`[^`\n]+`|<(code|pre|samp|kbd)\b[^>]*>", re.IGNORECASE)
_CODE_END = {tag: re.compile(end, re.IGNORECASE) for tag, end in [("```", "```"), *((t, f"</{t}>") for t in ("code", "pre", "samp", "kbd"))]}
_TUTORIAL = re.compile(
    r"\b(?:syntax|for example|e\.g\.|such as|is written|is called|stands for|template (?:engine|language)|placeholders? (?:like|such|look)|variables? (?:like|such|in)|"
    r"zum Beispiel|z\. ?B\.|Platzhalter wie|par exemple|s'écrit|por ejemplo|se escribe|например)(?!\w)",
    re.IGNORECASE,
)
_SENTENCE_END = re.compile(r"[.!?…](?=\s)|\n")

_START = r"(?:^|[.!?…:;>*»”\"\n]\s*|\*\s*)"
_FILLER = re.compile(
    r"lorem\s+ipsum\s+dolor|\b(?:asdf\s+){2,}|\basdf\s+jkl|\bqwert[yz]\s+qwert[yz]|"
    + _START
    + r"(?:this is (?:a |only |just )?(?:placeholder|dummy|sample|filler)\b|(?:placeholder|dummy|sample|filler) (?:copy|text|paragraph|content)\b(?=\W*$|[.!:,;]| for| goes| only)|"
    r"(?:your |the )?(?:text|copy|content|headline|title|caption|description) (?:goes here\b|here\b(?=\s*(?:$|[.!:,;|<\])])))|(?:insert|add|enter|type|write|put) (?:your|some|a|the) (?:\w+ )?(?:text|description|title|content|headline|caption|summary|bio)\b(?: goes)? here\b|your (?:own )?(?:headline|text|title|content|copy|logo)(?: goes)? here\b|"
    r"body copy goes\b|(?:please )?replace (?:it|this)(?: \w+)? with your own\b|enter an? (?:short )?(?:summary|description|title|text)\b.{0,40}\b(?:here|box|field|column)\b|"
    r"(?:description|text|content|details) to be (?:added|supplied|written|announced)\b|content coming soon\b|"
    r"Platzhalter(?:text)?\b\s*[,;:.!]|Blindtext (?:für|zum|bitte)\b|Hier (?:steht|kommt) Ihr\w* |Beispieltext\b\s*[,;:.!]|Ihr(?:e Überschrift| Text| Titel) hier\b|(?:Überschrift|Text|Titel|Beschreibung) hier (?:eingeben|einfügen)\b|"
    r"Texte d['’]exemple\b|Faux texte (?:pour|à)\b|Votre (?:texte|titre) ici\b|Texte à remplacer\b|"
    r"Escriba aquí su (?:texto|título)\b|Texto de (?:relleno|ejemplo|muestra)\b\s*[,;:.!]|(?:Su|Tu|Escriba su) (?:texto|título) aquí\b|"
    r"Текст[- ](?:заполнитель|заглушка)\b|Здесь (?:будет|должен быть|находится) (?:ваш )?текст\b|Ваш (?:текст|заголовок) здесь\b|Образец текста\b|Пример текста\b)",
    re.IGNORECASE | re.MULTILINE,
)
_ERROR = re.compile(
    r"\bHTTP(?:/\d(?:\.\d)?)?\s*(?:error\s*)?[45]\d\d\b\s*[-–—:]|\b[45]\d\d\b\s*[-–—:]?\s*(?:not found|bad request|unauthorized|forbidden|gone|internal server error|bad gateway|service unavailable|gateway time-?out)\b|"
    r"\b(?:error|fehler|erreur|errore|error de servidor|ошибка)\s*(?:code\s*)?#?\d{3,5}\s?:|"
    r"\b(?:internal server error|interner serverfehler|erreur interne du serveur|error interno del servidor|внутренняя ошибка сервера)\b|"
    r"\bbad gateway\b|\bgateway time-?out\b|\bservice (?:is )?(?:temporarily |currently )?(?:unavailable|down)\b|\btoo many requests\b|\b(?:please )?try again in \d+ (?:seconds|minutes)\b|"
    r"\bserver is (?:temporarily )?(?:unavailable|down|overloaded)\b|\b(?:upstream|origin) (?:host|server) did not\b|\bconnection (?:timed out|refused|reset)\b|\brequest (?:was blocked|timed out|could not be)\b|"
    r"\baccess (?:is )?denied\s*(?:[.!<]|$)|\byou do(?: not|n['’]t) have permission\b|\b(?:the )?page (?:you (?:asked for|requested|are looking for)|was not found|not found|cannot be found)\b|"
    r"\bwe can(?:['’]t|not) find (?:that|the|this) page\b|\bwas not found on this server\b|\bhas moved or no longer exists\b|\b(?:your )?session (?:has )?(?:expired|timed out)\b|"
    r"\bsomething went wrong(?: on our end|[.!,]|$)|\b(?:unexpected|unknown) (?:problem|error|failure) has? ?occurred\b|\bunable to connect to\b|\bcould not connect to (?:the )?(?:database|server|host)\b|"
    r"\btraceback \(most recent call last\)|\b[\w.]*(?:exception|error)\b\s+at\s+[\w.$]+\(|\b[a-z]+(?:\.[\w$]+)+\.?\w*(?:exception|error)\b|\bat [\w.$]+\([\w$]+\.(?:java|kt|scala|js|ts|cs):\d+|\b(?:Key|Value|Type|Name|Index|Attribute|Syntax|Import|Runtime)Error\s*:|"
    r"\b(?:fatal|parse|syntax|uncaught)[ \w]{0,12} ?error\s*:|\bcall to undefined\b|\bundefined (?:index|variable|offset)\b|\bsegmentation fault\b|\b(?:warning|notice|deprecated): \w+\(|\berror establishing (?:a|the) \w+ connection\b|\bsite can(?:['’]t|not) be reached\b|\bcore dumped\b|\bstack trace\s*:|\bpanic: |"
    r"\bSeite (?:wurde )?nicht gefunden\b|\bZugriff verweigert\b\s*(?:[.!<]|$)|\bkeine Berechtigung für diese Seite\b|\bSitzung ist abgelaufen\b|\bServer (?:antwortet nicht|ist (?:derzeit|vorübergehend) nicht)|\bDienst (?:ist )?(?:vorübergehend |derzeit )?nicht verfügbar\b|"
    r"\bpage (?:demandée )?(?:est |n['’]est pas )?(?:introuvable|trouvée)\b|\berreur de connexion à la base\b|\baccès refusé\b\s*(?:[.!<]|$)|\bvous n['’]avez pas l['’]autorisation\b|\bvotre session a expiré\b|\bservice (?:temporairement )?indisponible\b|\ble serveur ne répond pas\b|\bréessayez dans \d+|"
    r"\bpágina (?:solicitada )?no (?:encontrada|existe|se encuentra)\b|\bno se (?:ha encontrado|encontró|pudo encontrar) la página\b|\bacceso denegado\b\s*(?:[.!<]|$)|\bno tiene permiso para (?:ver|acceder)\b|\bla sesión ha caducado\b|\bservicio no disponible\b|\bel servidor no responde\b|\binténtelo dentro de \d+|"
    r"\bстраница не найдена\b|\bдоступ (?:запрещ[её]н|закрыт)\b\s*(?:[.!<]|$)|\bу вас нет (?:прав|доступа|разрешения)\b|\bсеанс истёк\b|\bсессия истекла\b|\bсервер (?:временно )?(?:недоступен|не отвечает)\b|\bповторите через \d+",
    re.IGNORECASE | re.MULTILINE,
)
_ERROR_NAME = re.compile(r"\bERR_[A-Z]+(?:_[A-Z]+)+\b")  # in capitals only
_SCRIPTS = re.compile(
    r"\b(?:enable|activate|allow|turn on|switch on|unblock)\s+(?:\w+\s+){0,2}?(?:javascript|js|scripts?|scripting)\b|\b(?:javascript|js|scripting|scripts?) (?:is|are) (?:\w+ )?(?:disabled|turned off|switched off|blocked|required|not enabled)\b|\b(?:javascript|js|scripting|scripts) (?:must|should|has to|have to|needs? to) be (?:enabled|allowed|activated|(?:turned|switched) on)\b|"
    r"\b(?:page|site|app|application|content|website)s? (?:needs?|requires?) (?:javascript|js|scripts?|scripting)\b|(?:\bnot|n['’]t) (?:work|run|load|function)(?: properly)? without (?:javascript|js|scripts?)\b|"
    r"\bbrowser does(?: not|n['’]t) (?:run|support|execute|allow) (?:javascript|js|scripts?)\b|\bscript blocker is (?:active|on)\b|"
    r"\b(?:aktivieren|erlauben) Sie (?:bitte )?(?:JavaScript|Skripte)\b|\b(?:benötigt|braucht|erfordert) (?:JavaScript|Skripte)\b|\bführt keine Skripte aus\b|\bJavaScript ist (?:deaktiviert|ausgeschaltet|nicht aktiviert)\b|"
    r"\b(?:activer|activez|autoriser|autorisez) (?:le |les )?(?:JavaScript|scripts)\b|\b(?:nécessite|requiert) (?:JavaScript|des scripts)\b|\bn['’]exécute pas (?:les scripts|JavaScript)\b|\bJavaScript est désactivé\b|"
    r"\b(?:active|activar|habilite|habilitar|permita) (?:el |los )?(?:JavaScript|scripts)\b|\b(?:necesita|requiere) (?:JavaScript|scripts)\b|\bno ejecuta (?:los )?(?:scripts|JavaScript)\b|\bJavaScript está desactivado\b|"
    r"\b(?:включите|разрешите|включить|разрешить) (?:JavaScript|скрипты|сценарии)\b|\b(?:нужен|нужны|требует(?:ся)?|требуются|необходим) (?:JavaScript|скрипты)\b|\bбраузер не (?:выполняет|исполняет|поддерживает) (?:JavaScript|скрипты|сценарии)\b|\bJavaScript (?:отключ[её]н|выключен)\b|\bбез JavaScript не работает\b|\bне работает без JavaScript\b",
    re.IGNORECASE,
)
_WORD = re.compile(r"[^\W\d_]+")

# Literals of which every match of a family holds one: texts without them skip the regular expression.
_HINTS = {
    "placeholder": ("{", "[", "<", "%", "$", "#", "@@", "__", "xxxx", "&lt;", "undefined", "null", "nan", "none"),
    "filler": (
        "copy",
        "ipsum", "asdf", "qwert", "here", "hier", "aquí", "ici", "placeholder", "dummy", "sample", "filler", "replace", "enter a", "to be ", "coming soon",
        "platzhalter", "blindtext", "beispieltext", "texte", "texto", "текст", "заголовок",
    ),
    "error": (
        "http", "error", "fehler", "erreur", "ошибка", "40", "41", "42", "43", "45", "50", "gateway", "service", "servicio", "dienst", "too many", "try again", "server", "connect",
        "upstream", "origin", "request", "denied", "permission", "page", "session", "moved", "went wrong", "occurred", "traceback", "exception", ".java", ".kt", ".scala", ".js", ".ts", ".cs",
        "undefined", "segmentation", "dumped", "stack trace", "panic", "seite", "zugriff", "sitzung", "refusé", "autorisation", "serveur", "réessayez", "página", "denegado", "permiso", "sesión",
        "servidor", "inténtelo", "err_", "be reached", "warning:", "notice:", "deprecated:", "страница", "доступ", "у вас нет", "сеанс", "сессия", "сервер", "повторите", "ошибка",
    ),
    "scripts": ("script", "skript", "js", "скрипт", "сценари"),
}
_LATIN_WORDS = re.compile(rf"(?<![^\W\d_])(?:{'|'.join(sorted(LATIN_FILLER))})(?![^\W\d_])")
_AGAIN = re.compile(r"\b([^\W\d_]{3,})(?:\s+\1\b){2,}")


def _sentence(text: str, at: int, ends: list[int]) -> tuple[int, int]:
    from bisect import bisect_right

    i = bisect_right(ends, at)
    return (ends[i - 1] if i else 0), (ends[i] if i < len(ends) else len(text))


def _is_field(word: str, text: str, start: int, end: int) -> bool:
    """A bracketed word is a placeholder if it is built like, or is, the name of a field."""
    if re.search(r"[_.\[]|\w-\w", word) and not re.search(r"\.$", word):
        return True
    parts = word.split()
    if all(p.lower() in FIELD_WORDS for p in parts):
        return True
    near = text[max(0, start - 80) : start] + text[end : end + 80]
    if word.isupper() and len(word) > 1 and any(c.islower() for c in near):
        return True
    return bool(_GREETING.search(text[max(0, start - 40) : start]))


def _placeholders(text: str) -> int:
    spans = [m.span() for m in _PLACEHOLDERS.finditer(text)]
    for m in _BRACKETED.finditer(text):
        if m[1] is not None:
            if _is_field(m[1], text, m.start(), m.end()):
                spans.append(m.span())
        elif m[2].lower() not in HTML_TAGS and f"</{m[2]}" not in text:
            spans.append(m.span())
    if not spans:
        return 0
    ends = [m.end() for m in _SENTENCE_END.finditer(text)]
    by_sentence: dict[tuple[int, int], int] = {}
    for s, _ in spans:
        key = _sentence(text, s, ends)
        by_sentence[key] = by_sentence.get(key, 0) + 1
    return sum(n for (a, b), n in by_sentence.items() if not (n <= 2 and _TUTORIAL.search(text, a, b)))


def _latin(text: str) -> bool:
    """Filler Latin by density: five of eight successive words."""
    hits, window = 0, []
    for m in _WORD.finditer(text):
        w = m[0] in LATIN_FILLER
        window.append(w)
        hits += w
        if len(window) > 8:
            hits -= window.pop(0)
        if hits >= 5:
            return True
    return False


def _without_code(text: str) -> str:
    """``text`` with a blank for each piece of code; a marker that is never closed is plain text."""
    out, kept, at, unclosed = [], 0, 0, set()
    while m := _CODE_START.search(text, at):
        tag, end = (m[1] or m[2] or "").lower(), m.end()
        close = _CODE_END[tag].search(text, end) if tag and tag not in unclosed else None
        at = close.end() if close else end
        if tag and not close:
            unclosed.add(tag)
            continue
        out.append(text[kept : m.start()])
        kept = at
    return " ".join([*out, text[kept:]])


def residue(text: str | None) -> tuple[bool, bool, bool, bool]:
    """Whether ``text`` holds a placeholder, filler, an error message, a script notice."""
    if text is None or not text.strip():
        return False, False, False, False
    low = text.lower()
    maybe = {k: any(h in low for h in hints) for k, hints in _HINTS.items()}
    return (
        maybe["placeholder"] and _placeholders(_without_code(text)) > 0,
        bool(maybe["filler"] and _FILLER.search(text)) or bool(_AGAIN.search(low)) or (len(_LATIN_WORDS.findall(low)) >= 5 and _latin(low)),
        bool(maybe["error"] and (_ERROR.search(text) or _ERROR_NAME.search(text))),
        bool(maybe["scripts"] and _SCRIPTS.search(text)),
    )


def residue_flags(documents: DataFrame) -> DataFrame:
    """``doc_id, placeholder, filler, error, scripts``, one row per input row; nothing is shuffled."""

    def flags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([residue(t) for t in b["text"]], columns=list(KINDS), index=b.index)
            yield pd.concat([b[["doc_id"]], out], axis=1)

    schema = "doc_id bigint, " + ", ".join(f"{k} boolean" for k in KINDS)
    return documents.select("doc_id", "text").mapInPandas(flags, schema)


def residue_documents(documents: DataFrame) -> DataFrame:
    """``doc_id`` of the documents that hold residue."""
    hit = " OR ".join(KINDS)
    return residue_flags(documents).where(f"({hit}) AND doc_id IS NOT NULL").select("doc_id").distinct()


def without_residue(documents: DataFrame) -> DataFrame:
    """The documents, all columns as they are, whose text holds none: one pass, nothing is shuffled."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([not any(residue(t)) for t in b.column("text").to_pylist()], pa.bool_()))

    return documents.mapInArrow(clean, documents.schema)
