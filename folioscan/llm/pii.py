"""Personal information in free text: where it stands, and text in which typed placeholders stand for it.

Kinds: email, phone, id_number, address, name. Numbers, addresses and mailboxes, plain or spelt out, are found by the shape
they have in writing; numbers of which the shape alone says too little count only if they are valid (check digits, dates,
ranges that are issued; see ``identifiers``). Names are found by what stands around them in English, German, French and
Spanish text: phrases that introduce a person, titles, greetings, closings, header lines, verbs of saying, a mailbox that
follows; and by given names that many people have. A name that has been found is found wherever else it stands in its text.

Placeholders keep values linked across documents without telling them: emails, addresses and names get a keyed digest of
128 bits; phone numbers, identity numbers and dates of birth are format-preserving pseudonyms: a keyed Feistel network
permutes the digits (and, by themselves, the letters) of a number of the same format, valid numbers among the valid ones,
and valid dates among valid dates. Equal values give equal pseudonyms however they are written, different ones different
pseudonyms, and who has the key can turn numbers and dates back. The prefix of a country is kept.

Defined results: null texts give no values and stay null; empty texts stay empty; null ids give no values; a value that
stands several times in a text is one row; where shapes overlap, the earlier of email, address, id_number, phone, name
holds; an empty table gives no rows. Texts are searched whole.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm import identifiers
from folioscan.llm.identifiers import SHAPES

KINDS = ("email", "address", "id_number", "phone", "name")
DATE = "date"

_UP = "".join(c for c in map(chr, range(0x41, 0x530)) if c.isupper())
_U = f"[{_UP}]"
_L = r"(?:[^\W\d_]|[̀-ͯ­​])"
_S = r"(?:[ \t   ]+|[ \t]*\r?\n[ \t]*(?:>[ \t]*)?)"  # a blank, or the break of a wrapped line
_W = rf"{_U}{_L}+(?:[-'’]{_L}+)*"

# --- mailboxes
_LOCAL = r"[A-Za-z0-9](?:[\w.+-]*[\w+-])?"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_TOP = r"[A-Za-z]{2,}(?![\w-])"
PLAIN = re.compile(rf"(?<![\w.+-]){_LOCAL}@(?:{_LABEL}\.)+{_TOP}")
_AT = rf"(?:{_S}?(?:\(at\)|\[at\]|\{{at\}}|<at>){_S}?|{_S}at{_S})"
_DOT = rf"(?:{_S}?(?:\(dot\)|\[dot\]|\{{dot\}}|<dot>){_S}?|{_S}dot{_S}|\.)"
SPELT = re.compile(rf"(?<![\w.+-]){_LOCAL}(?:{_S}?(?:\(at\)|\[at\]|\{{at\}}|<at>){_S}?(?:{_LABEL}{_DOT})+{_TOP}|{_S}at{_S}(?:{_LABEL}\.)*{_LABEL}{_S}dot{_S}(?:{_LABEL}{_DOT})*?{_TOP}(?:\.{_TOP})*)", re.I)
_NO_DOMAIN = re.compile(r"\sat\s+(?:the|a|an|this|that|its|each|every|any|no)\s", re.I)  # as in "look at the dot matrix"
HEADER = re.compile(r"^(?:Message-ID|In-Reply-To|References|Content-ID):", re.I)
#: What stands on a line before a bracketed mailbox, as opposed to a bracketed message identifier: a header, or a name.
MAILBOX = re.compile(rf"^[ \t>]*(?:(?i:From|To|Cc|Bcc|Reply-To|Sender):.*|.*{_W}[ \t]+{_W}[\"']?[ \t]*)<$")

# --- numbers
_EXT = rf"(?:,?{_S}?(?:ext\.?|extension|Durchwahl|poste|x){_S}?\d{{1,6}}(?!\w))?"
_N = r"(?![\w]|[-./]\d)"
PHONE = re.compile(
    r"(?<![\w.+/(-])(?:"
    rf"\+\d{{1,3}}(?:{_S}|[-./])?(?:\(\d{{1,5}}\){_S}?|\d{{1,5}}(?:{_S}|[-./]))\d{{7,9}}(?!\d)"
    rf"|\+\d{{1,3}}(?:{_S}|[-./])?(?:\(\d{{1,5}}\)|\d{{1,5}})(?:(?:{_S}|[-./])\d{{2,6}}){{1,5}}"
    rf"|\+\d{{1,3}}(?:{_S}|[-./])?\(0\)(?:{_S}|[-./])?\d{{1,5}}(?:(?:{_S}|[-./])\d{{7,9}}|(?:(?:{_S}|[-./])\d{{2,6}}){{1,5}})"
    rf"|\+\d{{1,3}}(?:{_S}|[-./])(?:\(0\))?\d{{6,12}}"
    r"|\+[1-9]\d{6,14}"
    rf"|\(\d{{2,5}}\){_S}?\d{{3,5}}(?:[-.]|{_S})\d{{3,6}}"
    rf"|\(0\d{{1,4}}\){_S}?\d{{5,9}}"
    rf"|\([2-9]\d{{2}}\){_S}?\d{{7}}"
    rf"|0\d{{1,4}}/\d{{3,7}}(?:-\d{{1,5}})?"
    rf"|0\d{{2,4}}{_S}\d{{3,4}}{_S}\d{{3,4}}"
    r"|07\d{3}[ \t]\d{6}"
    r"|0[1-9](?:[ .]\d{2}){4}"
    r"|\d{3}\.\d{3}\.\d{4}"
    r"|1-\d{3}-\d{3}-\d{4}"
    r"|[2-9]\d{2}-[2-9]\d{2}-\d{4}"
    rf"){_N}{_EXT}"
)
#: Local numbers, ten digits in a row and others that are one only where a word says so.
_CALLS = "phone telephone tel mobile cell fax call telefon mobil handy téléphone teléfono móvil".split()
CALLED = re.compile(rf"(?:{'|'.join(f(w) for w in _CALLS for f in (str.lower, str.capitalize, str.upper))})\b\.?:?{_S}?(?:(?i:me|us|number|no\.?|is|at|on)\b:?{_S})?(?P<v>\d(?:[ .-]?\d){{6,13}}){_N}")
ID_NUMBER = re.compile(
    r"(?<![\w.+/-])(?:"
    r"\d{3}-\d{2}-\d{4}"
    rf"|[A-Z]{{2}}(?:{_S})?\d{{2}}(?:{_S})?\d{{2}}(?:{_S})?\d{{2}}(?:{_S})?[A-D]"
    rf"|\d{{2}}{_S}\d{{3}}{_S}\d{{3}}{_S}\d{{3}}"
    r"|\d{6}[-+A]\d{3}[0-9A-Y]"
    r"|[A-Z]\d{2}[A-Z]\d{5}"
    r")(?![\w]|[-./]\d)"
)
#: Numbers that are one only where a word says so: nine digits and other runs of letters and digits.
_LABELS = ("ssn", "social security", "tax id", "tax number", "passport", "national id", "id number", "steuernummer", "ausweisnummer", "passnummer", "pasaporte", "passeport")
LABELLED = re.compile(rf"(?i:\b(?:ssn|social security(?: (?:number|no\.?))?|tax (?:id|number)|passport(?: (?:number|no\.?))?|national id|id number|steuernummer|ausweisnummer|passnummer|pasaporte|passeport))(?:{_S}(?i:is|number|no\.?|nr\.?))?:?{_S}?(?P<v>[A-Z]{{0,2}}\d[\dA-Z]{{6,11}})(?![\w-])")
BORN = re.compile(rf"\b(?:born|date of birth|DOB|geboren(?: am)?|né(?:e)? le|nacid[oa] el)[:=]?{_S}?(\d{{4}}-\d{{2}}-\d{{2}}|\d{{2}}[./]\d{{2}}[./]\d{{4}})\b")

# --- addresses
_SEP = rf"(?:,{_S}?|{_S})"
_OF = r"(?:de la|de los|de las|de l['’]|del|des|du|de|d['’])"
_STREET_EN = r"(?:Road|Lane|Gardens?|Close|Street|Avenue|Drive|Way|Court|Square|Terrace|Crescent|Place|Row|Hill|(?:St|Ave|Rd|Ln|Dr|Ct|Sq|Pl|Blvd)\b\.?)"
_TOWN = rf"{_W}"
_TOWNS = rf"{_W}(?:[ -]{_W}){{0,2}}"
_STREET_DE = r"(?:straße|strasse|str\.|gasse|weg|allee|platz|ring|damm|ufer)"
ADDRESS_EN = re.compile(
    rf"(?<![\w.-])(?:(?:Flat|Apartment|Apt\.?|Unit){_S}\d+[A-Za-z]?{_SEP})?\d{{1,5}}[a-z]?{_S}(?:{_W}{_S}){{1,3}}?{_STREET_EN}(?:{_S}(?:N|S)?(?:E|W)?\b)?{_SEP}"
    rf"{_TOWNS}(?:,{_S}?[A-Z]{{2}}{_S}\d{{5}}|,?{_S}[A-Z]{{1,2}}\d[A-Z\d]?{_S}\d[A-Z]{{2}})(?!\w)"
)
ADDRESS_DE = re.compile(rf"(?<![\w-])(?:{_W}[ -]){{0,1}}?{_U}{_L}*?{_STREET_DE}{_S}\d{{1,4}}[a-z]?{_SEP}\d{{5}}{_S}{_TOWN}")
ADDRESS_FR = re.compile(
    rf"(?<![\w-])\d{{1,4}}(?:{_S}(?:bis|ter))?,?{_S}(?:rue|avenue|boulevard|place|chemin|allée|impasse|quai|cours|route){_S}(?:{_OF}{_S}?)?{_W}(?:[ -]{_W})?{_SEP}\d{{5}}{_S}{_TOWN}"
)
ADDRESS_ES = re.compile(
    rf"(?<!\w)(?:Calle|C/|Avenida|Avda\.|Plaza|Paseo|Camino|Carrer|Ronda){_S}?(?:{_OF}{_S})?{_W}(?:[ -]{_W})?,?{_S}\d{{1,4}}(?:,{_S}?\d{{1,2}}\s?[ºª°.]{{1,2}}(?:{_S}?[A-Z](?!\w))?)?{_SEP}\d{{5}}{_S}{_TOWN}"
)

# --- names
#: Particles within names, titles before them, words that are capitalised but begin no name.
PARTICLES = "van von der den de del della di da dos du la le ter ten zu zum af bin al".split()
TITLES = "Dr Prof Mr Mrs Ms Herr Frau Mme Mlle Monsieur Madame Sr Sra Señor Señora Don Doña Ing Dipl".split()
NO_NAME = "Aq Mt Ao Bx The This That These Those And Or If It In On At To From Flat Calle Avenida Plaza Please Mark Send See Tel Phone Fon Fax Re Subject Date Cc Message Upgrade Mail Built When With For Thanks Kontakt Name Added Use You My All Each Every No Not Unlike Once Later Then Now Here There After Before While Since Because But So Also Today Yesterday Tomorrow Finally Meanwhile Perhaps However Although What Who Why How Where Our Your His Her Their Its".split()
_PT = rf"(?:{'|'.join(PARTICLES)})"
_I = rf"{_U}\."
_P = rf"(?!(?<=\n){_L}+:)(?!(?:{'|'.join(NO_NAME)})\b)(?!{_L}+(?:-{_L}+)?-(?:by|To|ID):){_W}"
_FULL = rf"(?:{_P}|{_I})(?:{_S}{_I})*(?:{_S}(?:{_PT}{_S}){{0,2}}{_P})"
_LAST_FIRST = rf"(?:{_PT}{_S}){{0,2}}{_P},{_S}{_P}(?![ \t]+\d)(?:{_S}{_I}(?!\w))*"
_LONGER = rf"{_P} {_FULL}(?!{_L})(?!{_S}\d)"  # two given names, on one line
_NAME = rf"(?:{_LAST_FIRST}|{_LONGER}|{_FULL})"
_TITLE = rf"(?:(?:{'|'.join(TITLES)})\b\.?{_S})*"
_HIT = rf"{_TITLE}(?P<n>{_NAME})"
#: (text that must occur, pattern): what introduces a person.
CUES = [
    (word, re.compile(pattern, re.M))
    for word, pattern in [
        ("written", rf"written{_S}by{_S}{_HIT}"),
        ("maintained", rf"maintained{_S}by{_S}{_HIT}"),
        ("Thanks", rf"Thanks{_S}to{_S}{_HIT}"),
        ("thanks", rf"thanks{_S}to{_S}{_HIT}"),
        ("checked", rf"checked{_S}by{_S}{_HIT}(?:{_S}and{_S}{_TITLE}(?P<n2>{_NAME}))?"),
        ("Mark", rf"Mark{_S}it{_S}for{_S}{_HIT}"),
        ("name=", rf"\bname={_S}?{_HIT}"),
        (".An", rf"^[ \t]*(?:{_L}+ )?\.An{_S}{_HIT}"),
        (".An", rf"(?<!\S)\.An{_S}{_HIT}"),
        ("-by:", rf"\b[A-Z][a-z-]+-by:{_S}?{_HIT}"),
        ("From:", rf"\bFrom:{_S}?\"?{_HIT}"),
        ("To:", rf"(?<![\w-])To:{_S}?\"?{_HIT}"),
        ("Cc:", rf"\bCc:{_S}?\"?{_HIT}"),
        ("wrote", rf"(?<![\w,]){_HIT}{_S}wrote:"),
        ("wrote", rf"\bOn{_S}[A-Z][a-z]{{2,8}},{_S}{_HIT}{_S}wrote:"),
        ("pointed", rf"\bAs{_S}{_HIT}{_S}pointed{_S}out"),
        ("Kontakt", rf"Kontakt:{_S}?{_HIT}"),
        ("Contact", rf"Contact:{_S}?{_HIT}"),
        ("Laut", rf"\bLaut{_S}{_HIT}"),
        ("Dank", rf"Dank{_S}an{_S}{_HIT}"),
        ("bersetzt", rf"bersetzt{_S}von{_S}{_HIT}"),
        ("Selon", rf"\bSelon{_S}{_HIT}"),
        ("Merci", rf"Merci{_S}à{_S}{_HIT}"),
        ("Traduit", rf"Traduit{_S}par{_S}{_HIT}"),
        ("Según", rf"\bSegún{_S}{_HIT}"),
        ("Gracias", rf"Gracias{_S}a{_S}{_HIT}"),
        ("Traducido", rf"Traducido{_S}por{_S}{_HIT}"),
        ("--", rf"^(?:[ \t>]*)--[ \t]*\r?\n[ \t>]*{_TITLE}(?P<n>{_NAME})[ \t]*\r?$"),
        ("-- ", rf"(?:^|\s)--{_S}{_TITLE}(?P<n>{_NAME})(?={_S}(?:Flat|\d|Calle|{_U}{_L}*{_STREET_DE}))"),
        ("name", rf"\b[Mm]y{_S}name{_S}is{_S}{_HIT}"),
        ("Name", rf"\b[Mm]ein{_S}Name{_S}ist{_S}{_HIT}"),
        ("appelle", rf"\b[Jj]e{_S}m['’]appelle{_S}{_HIT}"),
        ("llamo", rf"\b[Mm]e{_S}llamo{_S}{_HIT}"),
        ("ombre", rf"\b[Mm]i{_S}nombre{_S}es{_S}{_HIT}"),
        ("ame:", rf"\b(?:name|Name|NAME):{_S}?{_HIT}"),
        ("om", rf"\b(?:Nom|Nombre):{_S}?{_HIT}"),
        ("'m ", rf"\bI['’]m{_S}{_HIT}"),
        ("his is", rf"\b[Tt]his{_S}is{_S}{_HIT}(?={_S}(?:from|calling|speaking|writing|here)\b)"),
        ("Hier", rf"\bHier{_S}(?:ist|spricht){_S}{_HIT}"),
        ("ear", rf"\b(?:Dear|dear){_S}{_HIT}(?=[ \t]*[,:!\n])"),
        ("Hi", rf"\bHi{_S}{_HIT}(?=[ \t]*[,:!\n])"),
        ("Hello", rf"\bHello{_S}{_HIT}(?=[ \t]*[,:!\n])"),
        ("Hallo", rf"\bHallo{_S}{_HIT}(?=[ \t]*[,:!\n])"),
        ("Liebe", rf"\bLieber?{_S}{_HIT}(?=[ \t]*[,:!\n])"),
        ("Cher", rf"\bChère?{_S}{_HIT}|\bCher{_S}(?:{_TITLE})(?P<n2>{_NAME})(?=[ \t]*[,:!\n])"),
        ("Estimad", rf"\bEstimad[oa]{_S}{_HIT}(?=[ \t]*[,:!\n])"),
        ("uthor", rf"\b[Aa]uthors?:?{_S}(?:is{_S}|was{_S})?{_HIT}"),
        ("Autor", rf"\bAutor(?:in)?:{_S}?{_HIT}"),
        ("Auteur", rf"\bAuteur:{_S}?{_HIT}"),
        ("aintainer", rf"\b[Mm]aintainer:?{_S}(?:is{_S}|was{_S})?{_HIT}"),
        ("eported", rf"\b[Rr]eported{_S}by{_S}{_HIT}"),
        ("eviewed", rf"\b[Rr]eviewed{_S}by{_S}{_HIT}"),
        ("contributed", rf"\bcontributed{_S}by{_S}{_HIT}"),
        ("ontact", rf"\b[Cc]ontact{_S}{_HIT}"),
        ("igned", rf"\b[Ss]igned(?::|{_S}by){_S}{_HIT}"),
        ("egards", rf"^[ \t>]*(?:\w+{_S})?(?:\w+{_S})?[Rr]egards,?[ \t]*\r?\n(?:[ \t>]*\r?\n)?[ \t>]*{_TITLE}(?P<n>{_NAME})[ \t]*\r?$"),
        ("incerely", rf"^[ \t>]*(?:Yours{_S})?[Ss]incerely(?:{_S}yours)?,?[ \t]*\r?\n(?:[ \t>]*\r?\n)?[ \t>]*{_TITLE}(?P<n>{_NAME})[ \t]*\r?$"),
        ("heers", rf"^[ \t>]*[Cc]heers,?[ \t]*\r?\n(?:[ \t>]*\r?\n)?[ \t>]*{_TITLE}(?P<n>{_NAME})[ \t]*\r?$"),
        ("hanks", rf"^[ \t>]*(?:Many{_S})?[Tt]hanks,?[ \t]*\r?\n(?:[ \t>]*\r?\n)?[ \t>]*{_TITLE}(?P<n>{_NAME})[ \t]*\r?$"),
        ("Grüße", rf"Grüße(?:n)?,?[ \t]*\r?\n(?:[ \t>]*\r?\n)?[ \t>]*{_TITLE}(?P<n>{_NAME})[ \t]*\r?$"),
        ("Gruß", rf"Gruß,?[ \t]*\r?\n(?:[ \t>]*\r?\n)?[ \t>]*{_TITLE}(?P<n>{_NAME})[ \t]*\r?$"),
        ("ordialement", rf"[Cc]ordialement,?[ \t]*\r?\n(?:[ \t>]*\r?\n)?[ \t>]*{_TITLE}(?P<n>{_NAME})[ \t]*\r?$"),
        ("aludos", rf"[Ss]aludos,?[ \t]*\r?\n(?:[ \t>]*\r?\n)?[ \t>]*{_TITLE}(?P<n>{_NAME})[ \t]*\r?$"),
    ]
]
TITLED = re.compile(rf"(?:{'|'.join(t for t in TITLES if t not in ('Ing', 'Dipl'))})\b\.?{_S}{_TITLE}(?P<n>{_LONGER}|{_FULL})")
#: What follows a person: found first, the name is then looked for in the LOOK_BACK characters before it.
LOOK_BACK = 160
FOLLOWING = [(word, re.compile(rf"(?<![\w,-]){_HIT}{_S}{pattern}")) for word, pattern in (("said", r"(?:has{0})?said\b".format(_S)), ("asked", r"(?:has{0})?asked\b".format(_S)), ("told", r"(?:has{0})?told\b".format(_S)), ("replied", r"(?:has{0})?replied\b".format(_S)), ("sagt", r"sagte?\b"))]
MAILED = re.compile(rf"(?<![\w-])(?P<n>{_NAME})[\"']?[ \t]*(?=[<(]{_LOCAL}@)")
OPENED = re.compile(rf"[<(]{_LOCAL}@")

# Given names that many people have in countries of these languages, none of them also a common word.
GIVEN = """Aaron Adrian Ahmed Alberto Alejandro Alex Alexander Alice Amanda Amelia Andrea Andreas Andrew Angela Anja Anna Anne Anthony
    Antoine Antonio Arthur Barbara Beatriz Benjamin Bernd Birgit Brian Camille Carlos Carmen Caroline Catherine Charles Charlotte
    Christian Christine Christopher Claire Claudia Cristina Daniel David Deborah Diego Dieter Dirk Dorothy Eduardo Edward Elena
    Elizabeth Emily Emma Enrique Eric Fatima Felix Fernando Francisco François Frank Franz Gabriel George Georg Gerhard Giulia Hannah Hans Heike
    Heinz Helen Henry Hugo Ingrid Isabel Isabelle Jacques James Jan Jane Janet Javier Jean Jennifer Jessica Joan Johannes John Jonathan
    Jorge José Joseph Joshua Juan Julia Julie Karen Karin Karl Katharina Katherine Kenneth Kevin Klaus Laura Laurent Linda Lisa Louise Lucas Lucía
    Luis Luisa Manuel Manfred Marc Margaret Maria María Marie Mario Martin Martina Mary Matthew Matthias Michael Michel Michelle Miguel Mohamed Monika
    Nancy Nathalie Nicolas Nicole Olivia Pablo Patricia Patrick Paul Paula Pedro Peter Philippe Pierre Rachel Raúl Rebecca Richard Robert Roberto
    Ronald Rosa Sabine Samuel Sandra Sara Sarah Sergio Sofia Sophie Stefan Stephanie Stephen Susan Susanne Thomas Ursula Walter Werner William Wolfgang""".split()
GIVEN_SET = frozenset(GIVEN)
CAPITAL = re.compile(rf"[{''.join(sorted({g[0] for g in GIVEN}))}]{_L}+")
KNOWN = re.compile(rf"(?P<n>{_L}+(?:-{_W})?(?:[ \t]{_I})*(?:[ \t](?:{_PT}[ \t]){{0,2}}{_P}){{1,2}})(?![\w-])")


class Spans:
    """Stretches of a text that have been taken, kept in order: a new one is held against its neighbours alone."""

    def __init__(self, found: list[tuple[int, int, str]] | None = None):
        self.found = sorted(found or [])
        self.starts = [x[0] for x in self.found]

    def meets(self, a: int, b: int) -> bool:
        i = bisect.bisect_left(self.starts, a)
        return (i > 0 and self.found[i - 1][1] > a) or (i < len(self.found) and self.found[i][0] < b)

    def add(self, a: int, b: int, kind: str) -> None:
        if not self.meets(a, b):
            i = bisect.bisect_left(self.starts, a)
            self.starts.insert(i, a)
            self.found.insert(i, (a, b, kind))


#: Of a line before a mailbox so much is looked at.
LINE_HEAD = 300


def _is_mailbox(text: str, line: int, m: re.Match) -> bool:
    """Told from message identifiers by the head of the line and, where there is no letter before the @, by what is before."""
    if HEADER.match(text[line : min(line + LINE_HEAD, m.start())].lstrip(" >\t")):
        return False
    bare = text.startswith(">", m.end()) and text[m.start() - 1 : m.start()] == "<" and not any(c.isalpha() for c in m.group().partition("@")[0])
    return not bare or bool(MAILBOX.match(text[max(line, m.start() - LINE_HEAD) : m.start()]))


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all values, in order."""
    spans = Spans()
    if "@" in text:
        line = seen = 0
        for m in PLAIN.finditer(text):
            line = max(line, text.rfind("\n", seen, m.start()) + 1)
            seen = m.start()
            if _is_mailbox(text, line, m):
                spans.add(m.start(), m.end(), "email")
    low = text.lower()
    if "(at)" in low or "[at]" in low or "{at}" in low or "<at>" in low or "dot" in low:
        for m in SPELT.finditer(text):
            if _NO_DOMAIN.search(m.group()):
                continue
            spans.add(m.start(), m.end(), "email")
    for pattern in (ADDRESS_EN, ADDRESS_DE, ADDRESS_FR, ADDRESS_ES):
        if _possible(pattern, text, low):
            for m in pattern.finditer(text):
                spans.add(m.start(), m.end(), "address")
    for m in ID_NUMBER.finditer(text):
        if identifiers.issued(m.group()):
            spans.add(m.start(), m.end(), "id_number")
    mistyped = Spans()  # account numbers that are not valid: no part of one is a phone number
    for m in SHAPES.finditer(text):
        if identifiers.valid(m.group()):
            spans.add(m.start(), m.end(), "id_number")
        elif m.group()[:2].isalpha():
            mistyped.add(m.start(), m.end(), "")
    if any(w in low for w in _LABELS):
        for m in LABELLED.finditer(text):
            spans.add(*m.span("v"), "id_number")
    for m in PHONE.finditer(text):
        if not mistyped.meets(m.start(), m.end()):
            spans.add(m.start(), m.end(), "phone")
    for m in CALLED.finditer(text):
        if _clear(text, m.start()):
            spans.add(*m.span("v"), "phone")
    for a, b in _names(text):
        spans.add(a, b, "name")
    _repeated(text, spans)
    return spans.found


def _clear(text: str, at: int) -> bool:
    """Whether no word goes on before this place."""
    return not at or not (text[at - 1].isalnum() or text[at - 1] in "_-")


def _names(text: str) -> Iterator[tuple[int, int]]:
    """Where names of people stand, as what is around them tells; some more than once."""
    for word, pattern in CUES:
        if word in text:
            for m in pattern.finditer(text):
                for group in ("n", "n2"):
                    if group in pattern.groupindex and m.group(group):
                        yield m.span(group)
    for m in TITLED.finditer(text):
        if _clear(text, m.start()):
            yield m.span("n")
    for word, pattern in FOLLOWING:
        at = text.find(word)
        while at >= 0:
            if m := pattern.search(text, max(0, at - LOOK_BACK), at + len(word) + 2):
                yield m.span("n")
            at = text.find(word, at + 1)
    if "@" in text:
        for k in OPENED.finditer(text):
            if m := MAILED.search(text, max(0, k.start() - LOOK_BACK), k.end()):
                if m.end() == k.start():
                    yield m.span("n")
    for k in CAPITAL.finditer(text):
        if k.group() in GIVEN_SET and _clear(text, k.start()) and (m := KNOWN.match(text, k.start())):
            yield m.span("n")


def _repeated(text: str, spans: Spans) -> None:
    """A name found in a text is found wherever else it stands there in the same letters."""
    for name in sorted({text[a:b] for a, b, k in spans.found if k == "name"}, key=len, reverse=True):
        at = text.find(name)
        while at >= 0:
            end = at + len(name)
            if not (at and (text[at - 1].isalnum() or text[at - 1] == "-")) and not (end < len(text) and (text[end].isalnum() or text[end] == "-")):
                spans.add(at, end, "name")
            at = text.find(name, end)


#: One of these must occur in a text before an address pattern is tried.
_STREET_WORDS = {
    ADDRESS_EN: ("Road", "Lane", "Garden", "Close", "Street", "Avenue", "Drive", "Way", "Court", "Square", "Terrace", "Crescent", "Place", "Row", "Hill", "St", "Ave", "Rd", "Ln", "Dr", "Ct", "Sq", "Pl", "Blvd"),
    ADDRESS_DE: ("straße", "strasse", "str.", "gasse", "weg", "allee", "platz", "ring", "damm", "ufer"),
    ADDRESS_FR: ("rue", "avenue", "boulevard", "place", "chemin", "allée", "impasse", "quai", "cours", "route"),
    ADDRESS_ES: ("Calle", "C/", "Avenida", "Avda", "Plaza", "Paseo", "Camino", "Carrer", "Ronda"),
}


def _possible(pattern: re.Pattern, text: str, low: str) -> bool:
    return any(w in text for w in _STREET_WORDS[pattern])


# --- pseudonyms
#: Steps along the permutation in search of a valid number; the share of valid ones is no less than one in some hundreds.
MOST_STEPS = 100_000


def _set_apart(plain: str, like: str) -> str:
    """Letters and digits in the places of those of another text."""
    chars = iter(plain)
    return "".join(next(chars) if c.isdigit() or "A" <= c <= "Z" else c for c in like)


class Pseudonyms:
    ROUNDS = 10

    def __init__(self, key: bytes):
        self.key = key
        self.known: dict[tuple[str, str], str] = {}

    def _round(self, label: str, i: int, half: int, size: int) -> int:
        d = hashlib.blake2b(f"{label}|{i}|{half}".encode(), key=self.key, digest_size=16).digest()
        return int.from_bytes(d, "big") % size

    def permute(self, value: int, base: int, length: int, label: str, back: bool = False) -> int:
        """A keyed permutation of the numbers of ``length`` digits to ``base``: a Feistel network on both halves."""
        if length == 1:
            shift = self._round(label, 0, 0, base)
            return (value - shift) % base if back else (value + shift) % base
        b_size = base ** (length - length // 2)
        a_size = base ** (length // 2)
        a, b = divmod(value, b_size)
        for i in reversed(range(self.ROUNDS)) if back else range(self.ROUNDS):
            sign = -1 if back else 1
            if i % 2:
                a = (a + sign * self._round(label, i, b, a_size)) % a_size
            else:
                b = (b + sign * self._round(label, i, a, b_size)) % b_size
        return a * b_size + b

    def _within(self, text: str, alphabet: str, label: str, back: bool) -> str:
        at = [i for i, c in enumerate(text) if c in alphabet]
        if not at:
            return text
        base, value = len(alphabet), 0
        for i in at:
            value = value * base + alphabet.index(text[i])
        value = self.permute(value, base, len(at), f"{label}|{len(at)}", back)
        out = list(text)
        for i in reversed(at):
            value, d = divmod(value, base)
            out[i] = alphabet[d]
        return "".join(out)

    def number(self, text: str, kind: str, back: bool = False) -> str:
        """Same length, separators and kinds of characters; digits among digits, letters among letters. A number that is
        valid in its format goes to a valid one: the permutation is followed until it is among those again. The digits
        alone decide, not how they are set apart; the country before a phone number stays."""
        if kind == "phone":
            fixed = re.match(r"\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})|", text)[0]
            plain = re.sub(r"\D", "", text[len(fixed) :])
            return fixed + _set_apart(self._within(plain, "0123456789", f"{kind}{fixed}", back), text[len(fixed) :])
        plain = re.sub(r"[^0-9A-Z]", "", text)
        label = kind + re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", plain))
        one = lambda v: self._within(self._within(v, "0123456789", label, back), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", label, back)
        form, v = identifiers.form_of(text), one(plain)
        if form is None:  # invalid ones stay among the invalid
            for _ in range(MOST_STEPS):
                if identifiers.form_of(_set_apart(v, text)) is None:
                    break
                v = one(v)
            return _set_apart(v, text)
        head, tail = form.payload(plain)  # what is free in this format; the check part follows from it
        label, free = f"{kind}{form.name}", head
        for _ in range(MOST_STEPS):
            free = self._within(self._within(free, "0123456789", label, back), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", label, back)
            whole = form.complete(free, tail)
            if whole is not None:
                return _set_apart(whole, text)
        return _set_apart(v, text)

    FIRST, DAYS = datetime.date(1900, 1, 1).toordinal(), 73_049  # to 2099-12-31

    def date(self, text: str, back: bool = False) -> str:
        """A valid date of 1900 to 2099 among those, in the same way of writing; other text as a number."""
        form = "%Y-%m-%d" if text[4:5] == "-" else f"%d{text[2:3]}%m{text[2:3]}%Y"
        try:
            n = datetime.datetime.strptime(text, form).date().toordinal() - self.FIRST
        except ValueError:
            return self.number(text, DATE, back)
        if not 0 <= n < self.DAYS:
            return self.number(text, DATE, back)
        n = self.permute(n, 10, 5, DATE, back)
        while n >= self.DAYS:  # walk along the cycle until it comes back among the dates
            n = self.permute(n, 10, 5, DATE, back)
        return datetime.date.fromordinal(n + self.FIRST).strftime(form)

    def placeholder(self, kind: str, value: str) -> str:
        plain = re.sub(r"\s*\n[\s>]*|\s+", " ", value)
        if (kind, plain) not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            if kind in ("phone", "id_number"):
                shown = self.number(plain, kind)
            elif kind == DATE:
                shown = self.date(plain)
            else:
                shown = hashlib.blake2b(f"{kind}|{plain.casefold()}".encode(), key=self.key, digest_size=16).hexdigest()
            self.known[kind, plain] = f"[{kind.upper()} {shown}]"
        return self.known[kind, plain]

    def redact(self, text: str) -> str:
        spans = find(text)
        taken = Spans(spans)
        if "b" in text or "n" in text:
            for m in BORN.finditer(text):
                taken.add(*m.span(1), DATE)
        out, at = [], 0
        for a, b, kind in sorted(taken.found):
            out += [text[at:a], self.placeholder(kind, text[a:b])]
            at = b
        return "".join(out) + text[at:]


def personal_values(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, kind, value), each value of a text once."""

    def scan(batches):
        for b in batches:
            ids, kinds, values = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if i is None or not t:
                    continue
                for kind, value in dict.fromkeys((k, t[x:y]) for x, y, k in find(t)):
                    ids.append(i)
                    kinds.append(kind)
                    values.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(values, pa.string())], ["doc_id", "kind", "value"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(scan, "doc_id bigint, kind string, value string")


def redacted(docs: DataFrame, doc_id: str, text: str, key: bytes) -> DataFrame:
    """(doc_id, text) with placeholders for all values; one row for each row of ``docs``."""

    def scan(batches):
        names = Pseudonyms(key)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t if not t else names.redact(t) for t in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(scan, "doc_id bigint, text string")
