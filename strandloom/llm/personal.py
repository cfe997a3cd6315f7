"""Personal information in free text: weak labellers, their reliabilities, and a span classifier trained on them."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Workspace

KINDS = ("email", "phone", "idnum", "address", "name")
#: Candidates that the span classifier is trained on; counts and reliabilities come from all candidates.
SAMPLE = 5_000
WIDTH = 1 << 12
#: Lines whose candidates a task remembers; they are forgotten together when there are more.
REMEMBER = 200_000
FOUND = "doc_id bigint, kind string, start_pos int, end_pos int"
_ROWS = "doc_id bigint, kind array<int>, first array<int>, last array<int>, votes array<int>, marks array<array<int>>"

_L = r"[^\W\d_]"
_GAP = r"[ \xa0]"
_AT = r"(?:@|[ \xa0]@[ \xa0]|[ \xa0]?[\[(](?:at|AT)[\])][ \xa0]?|[ \xa0]AT[ \xa0]|\{\{@\}\}|&#64;)"
_DOT = r"(?:\.|[ \xa0]?[\[(](?:dot|DOT)[\])][ \xa0]?|[ \xa0]DOT[ \xa0]|&#46;)"
_EMAIL = re.compile(rf"(?<![\w.%+\-])[A-Za-z0-9](?:[A-Za-z0-9._%+\-]*[A-Za-z0-9])?{_AT}[A-Za-z0-9\-]+(?:{_DOT}[A-Za-z0-9\-]+)*{_DOT}[A-Za-z]{{2,}}(?![\w\-])")

_MAIL_NEAR = re.compile(
    r"(?i)(?:(?<!\w)(?:e-?mail\w*|mail\w*|courriel|correo|address|adresse|dirección|reach|contact\w*|kontakt\w*|write|schreib\w*|écri\w*|escrib\w*|send|by|at|unter|an|à|a|or|oder|ou|o)(?!\w)[^\d!?]{0,25}|[|>(,;:–—*][ \xa0]*)$"
)

_S = r"[ \xa0.\-‑–]"
_EXT = rf"(?:{_GAP}?(?:ext\.?|extension|x|Durchwahl|poste|Nst\.){_GAP}?\d{{1,5}})?"
_PHONE = re.compile(
    r"(?:"
    rf"\+\d{{1,3}}{_S}?(?:\(0?\d{{0,4}}\){_S}?)?\d{{1,4}}(?:{_S}?\d{{1,4}}){{1,6}}"
    rf"|00\d{{2}}{_S}\d{{1,4}}(?:{_S}\d{{2,6}}){{1,5}}"
    rf"|\(\d{{2,5}}\){_GAP}?/?{_GAP}?\d{{2,4}}(?:{_S}\d{{2,4}}){{1,4}}"
    rf"|0\d{{2}}{_GAP}\d{{4}}{_GAP}\d{{4}}|0\d{{4}}{_GAP}\d{{6}}|0\d{{1,4}}{_GAP}\d{{6,8}}|0\d(?:{_S}\d\d){{4}}"
    rf"|0\d{{9,10}}|1?{_S}?[2-9]\d{{2}}{_S}[2-9]\d{{2}}{_S}\d{{4}}|1[2-9]\d{{9}}"
    rf"){_EXT}(?![\w]|[\-/.,]\d)"
)
#: A stretch of digits and signs between them: where numbers may be.
_DIGITS = re.compile(r"\d[\d \xa0.\-‑–/()]{3,}\d")
_DIGIT = re.compile(r"\d")
_BEFORE = re.compile(r"[\w.,/+\-‑–(]")
_ID = re.compile(
    r"(?:"
    rf"[A-Z]{{2}}-?\d{{3}}-?\d{{4}}|[A-Z]{{2}}{_GAP}?\d\d{_GAP}?\d\d{_GAP}?\d\d{_GAP}?[A-Z]|[A-Z]{{2}}\d{{7}}[A-Z]?|[A-Z]{{2}}-\d{{4}}-\d{{4}}-\d"
    rf"|\d{{3}}[\- \xa0]\d\d[\- \xa0]\d{{4}}|\d{{9}}|\d(?:{_GAP}?\d\d){{3}}{_GAP}?\d{{3}}{_GAP}?\d{{3}}{_GAP}?\d\d"
    r"|\d\d\.?\d{3}\.?\d{3}-?[A-ZÑ]|[XYZ]-?\d{7}-?[A-Z]|\d\d/\d{3}/\d{5}|[A-Z0-9]{9,10}"
    r")(?![\w]|[\-/.,]\d)"
)
_ID_WORD = (
    r"(?:pass(?:port|eport)|reisepass(?:nummer)?|pasaporte|nino|ni number|national insurance|insurance (?:card|number|no)|ssn|social(?: security)?|s[ée]cu(?:rit[ée] sociale)?|seguridad social|sozialversicherung\w*|"
    r"versicherungsnummer|num[ée]ro de s[ée]curit[ée]|dni|nie|nif|cif|tax (?:id|number|no)|taxpayer\w*|steuer\W?(?:id\w*|nr|nummer)|num[ée]ro fiscal|identificaci[óo]n fiscal|(?:id|identity) (?:card|number|no)|"
    r"personalausweis\w*|ausweis\w*|carte (?:nationale )?d.identit[ée]|documento de identidad|insee)"
)
#: A word for an identity number right before it, and one not far before or after it.
_ID_LABEL = re.compile(rf"(?i)(?<!\w){_ID_WORD}(?:[ \xa0]*(?:no|nr|number|nummer|n°|num|número|numéro|id)\b\.?)?[ \xa0]*(?:[:#=]|is|ist|est|es|lautet)?[ \xa0]*$")
_ID_NEAR = re.compile(rf"(?i)(?<!\w){_ID_WORD}(?!\w)[^!?|;()]{{0,40}}$")
_ID_RIGHT = re.compile(rf"(?i)^[^!?|;()\d]{{0,25}}(?:(?<!\w){_ID_WORD}(?!\w)|\b(?:holder|inhaber(?:in)?|titular|titulaire|au nom de|form\b|issued|ausgestellt|délivré|expedido))")
_ID_STRONG = re.compile(r"\d{3}[\- \xa0]\d\d[\- \xa0]\d{4}|[A-Z]{2}[ \xa0]?\d\d[ \xa0]?\d\d[ \xa0]?\d\d[ \xa0]?[A-Z]|\d\d\.?\d{3}\.?\d{3}-?[A-ZÑ]|[XYZ]-?\d{7}-?[A-Z]|\d(?:[ \xa0]?\d\d){3}[ \xa0]?\d{3}[ \xa0]?\d{3}[ \xa0]?\d\d")
#: Words around telephone numbers, or signs of a list of contacts before one.
_PHONE_NEAR = re.compile(
    r"(?i)(?:(?<!\w)(?:tel|tél|phone|telephone|fon|fax|mobile?|mobil|cell|call|ring|dial|text|whatsapp|sms|number|reach|contact|unter|rufnummer|nummer|handy|anruf\w*|ruf\w*|telefon\w*|appel\w*|téléphone\w*|numéro|joindre|portable|"
    r"llam\w*|teléfono|móvil|número|contact\w*|hotline)(?!\w)[^\d!?]{0,25}|[|>(,;][ \xa0]*|(?<!\w)(?:or|oder|ou|o)[ \xa0])$"
)
_NUMBER_OTHER = re.compile(r"(?i)(?:isbn|issn|revision|version|no\.|lot|accession|ip|population|code|(?:was|were|war|était|era) |catalogue|order|invoice|isbn=|year=|pmid|doi|=|/p/|/)[ \xa0.:]*$")

_HOUSE = r"\d{1,4}[a-z]?(?:[ \xa0]bis)?"
_FLAT = r"(?:flat|apt\.?|apartment|unit|suite|appt\.?|whg\.?|wohnung)[ \xa0]\d+[a-z]?"
_PROPER = rf"{_L}[\w'’\-]*"
_TOWN = rf"(?:,[ \xa0](?:\d{{5}}[ \xa0])?(?P<town>{_PROPER})(?:[ \xa0](?:[A-Z]{{1,2}}\d{{1,2}}[A-Z]?[ \xa0]\d[A-Z]{{2}}|\d{{5}})(?!\w))?)?"
_STREET_EN = (
    "street st. st road lane close avenue crescent drive court way terrace square place boulevard highway parkway gardens garden grove mews row walk rise view green circle trail heights quay wharf yard passage alley "
    "embankment esplanade parade park hill gate"
).split()
_STREET_FR = "rue bd boulevard avenue av place chemin allée impasse quai route cours square passage sentier faubourg esplanade promenade venelle hameau cité".split()
_STREET_ES = "c/ calle avda avenida plaza pza paseo camino carrera carretera ronda travesía glorieta pasaje rambla vía callejón cuesta urbanización alameda bulevar".split()
_STREET_DE = "straße strasse str. weg allee gasse platz damm ufer ring pfad steig stieg chaussee promenade markt hof winkel kamp graben".split()
#: Types of street that are common words of other meanings too.
_VAGUE = {"way", "view", "green", "park", "hill", "gate", "garden", "gardens", "row", "walk", "rise", "circle", "trail", "heights", "yard", "passage", "place", "court", "close", "ring", "hof", "markt", "cours", "route", "square", "cité", "vía", "parade", "drive"}


def _any(words: list[str]) -> str:
    return "|".join(re.escape(w) + (r"\.?" if w in ("bd", "av", "avda", "pza") else "") for w in words)


_ADDRESS = [
    (re.compile(rf"(?i)(?<![\w.,])(?:{_FLAT},[ \xa0])?{_HOUSE}[ \xa0](?P<street>(?:{_PROPER}[ \xa0]){{1,3}}?(?P<type>{_any(_STREET_EN)}|(?:rd|ln|ave|av|cres|dr|blvd|sq|gdns)(?:\.(?=[,;]))?))(?!\w)(?:,[ \xa0]{_FLAT})?{_TOWN}"), "en"),
    (re.compile(rf"(?i)(?<![\w.,]){_HOUSE},?[ \xa0](?P<street>(?P<type>{_any(_STREET_FR)})[ \xa0](?:(?:de|du|des|la|le)[ \xa0]|(?:de l|d|l)['’])*{_PROPER})(?:,[ \xa0]{_FLAT})?{_TOWN}"), "fr"),
    (re.compile(rf"(?i)(?<![\w.,])(?P<street>(?P<type>{_any(_STREET_ES)})[ \xa0](?:(?:de|del|la|las|los)[ \xa0])*{_PROPER}),?[ \xa0](?:n[.º°]*[ \xa0])?{_HOUSE}(?!\w)(?:,[ \xa0]\d{{1,2}}\.?[ºª°][ \xa0]?{_L}(?!\w))?{_TOWN}"), "es"),
    (re.compile(rf"(?i)(?<![\w.,])(?P<street>{_PROPER}(?P<type>{_any(_STREET_DE)})|{_PROPER}[ \xa0](?P<type2>{_any(_STREET_DE)})|(?:am|an der|auf der|auf dem|zum|zur|beim)[ \xa0]{_PROPER})[ \xa0]{_HOUSE}(?!\w)(?:,[ \xa0]{_FLAT})?{_TOWN}"), "de"),
]
_ARTICLE = re.compile(r"(?i)(?:the|der|die|das|den|dem|des|diese\w?|le|les|el|los|las|un|une|una|ein|eine)[ \xa0]")
#: Words for living, moving or writing to somewhere, not far before an address.
_ADDRESS_LEFT = re.compile(
    r"(?i)(?<!\w)(?:lives?|lived|living|moved|resid\w+|stay\w*|address\w*|located|home|house|office|delivered?|ship\w*|send|sent|post|letters?|write|visit\w*|at|habit\w*|demeur\w*|domicili\w*|résid\w*|adress\w*|écri\w*|envo\w*|chez|"
    r"wohn\w*|zuhause|anschrift|schreib\w*|schick\w*|zieh\w*|zog\w*|bitte|vivo|vive\w*|viv\w+|domicilio|dirección|escrib\w*|enviar?|envíe\w*)(?!\w)[^!?|;]{0,45}$"
)

_PARTICLE = r"(?:van der|van den|van de|van|von der|von|zu|de la|de los|de|del|della|da|dos|di|du|der|den|ter|le|la)"
_WORD = rf"{_L}{{2,}}"
_FAMILY = rf"{_WORD}(?:-{_WORD})?"
_INITIALS = rf"{_L}\.(?:[ \xa0]?{_L}\.)*"
#: Given names or initials, further given names, initials and a particle, then the family name ...
_NAME = re.compile(rf"(?i)(?:{_WORD}|{_INITIALS})(?:{_GAP}(?:{_WORD}|{_INITIALS})){{0,2}}?(?:{_GAP}{_PARTICLE})?{_GAP}{_FAMILY}")
_FULL = re.compile(rf"(?i)(?:{_WORD}|{_INITIALS})(?:{_GAP}(?:{_WORD}|{_INITIALS})){{0,2}}(?:{_GAP}{_PARTICLE})?{_GAP}{_FAMILY}")
_NEXT = re.compile(rf"{_GAP}({_FAMILY}|(?:{_L}\.)+)")
#: Words and initials with capitals right before a family name, from each of them on.
_HEADS = re.compile(rf"(?<![\w.\-])(?=((?:[^\W\d_a-zß-ÿ][^\W\d_]*\.?{_GAP}(?:{_PARTICLE}{_GAP})?){{1,3}})\Z)")
_IS_PARTICLE = re.compile(r"(?:van|von|den|der|zu|de|la|los|del|della|da|dos|di|du|ter|le)").fullmatch
#: ... or the family name first.
_TURNED = re.compile(rf"(?i){_FAMILY},{_GAP}(?:{_WORD}|{_INITIALS})(?:{_GAP}(?:{_INITIALS}))?(?:{_GAP}{_PARTICLE}(?!\w))?")
_TITLE = r"(?:dr|mr|mrs|ms|miss|sir|prof|professor|hr|frau|herr|herrn|monsieur|madame|mme|mlle|señora?|sr|sra|don|doña)\b\.?(?: dr\.?)?"
#: What stands before people: titles, greetings, words for people and for naming, asking and addressing them.
_PERSON = (
    rf"{_TITLE}|hi|hello|hey|dear|hallo|liebe|lieber|bonjour|cher|chère|hola|querid[oa]|estimad[oa]|"
    r"holder|owner|inhaber(?:in)?|titular|titulaire|au nom de|signed|gezeichnet|signé(?: par)?|firmado(?: por)?|regards,?|sincerely,?|grüße,?|cordialement,?|saludos,?|attn\.?:?|c/o|"
    r"name is|named|name's|name:|heißt|heiße|namens|appelle|nommée?|llamo|llama|llamad[oa]|nombre:|nom ?:|contact|contact[ \xa0]*[=:]|kontakt:?|ansprechpartner(?:in)?:?|"
    r"ask(?:ed)? for|ask|(?:talk|speak|spoke)(?:ed)? (?:to|with)|met|meet|thank|thanks to|phone|ring|write to|wrote to|written by|edited by|gespräch mit|sprechen mit|fragen sie nach|(?:wende|wenden) (?:dich|sie sich) an|bitte an|écrire à|écrivez à|"
    r"entretien avec|parl\w+ (?:à|avec)|demande[rz]?|adressez-vous à|escribir a|escriba a|hablad?[oar]+ con|conversación con|entrevista (?:a|con)|pregunt\w+ por|"
    r"colleague|friend|neighbou?r|teacher|boss|manager|brother|sister|mother|father|wife|husband|son|daughter|uncle|aunt|cousin|doctor|patient|student|client|customer|author|curator|"
    r"kolleg(?:e|in)|freund(?:in)?|nachbar(?:in)?|lehrer(?:in)?|chef(?:in)?|bruder|schwester|mutter|vater|kund(?:e|in)|collègue|amie?|voisine?|professeure?|frère|sœur|mère|père|"
    r"colega|amig[oa]|vecin[oa]|profesora?|herman[oa]|madre|padre"
)
_LEFT = re.compile(rf"(?i)(?:(?<!\w)(?:{_PERSON})|—|^\*|\s\*|\|\|)[ \xa0]*$")
#: What people do, have and are, after their names.
_DOING = (
    r"lives?|lived|said|says|wrote|writes|works?|worked|told|asked|called|phoned|emailed|joined|moved|answered|replied|thinks|added|explained|married|teaches|studies|can be reached|was born|is an?|"
    r"sagte|sagt|schrieb|schreibt|wohnt|wohnte|arbeitet|arbeitete|rief|meinte|heiratete|ist erreichbar|habite|habitait|travaille|travaillait|dit|écrit|est né|vive|vivía|trabaja|trabajaba|dijo|escribió|llamó|nació"
)
_RIGHT = re.compile(
    rf"(?i)^(?:[ \xa0](?:(?:{_DOING})(?!\w)|from[ \xa0]|\(\+?[\d(]|\((?:tel|tél)|–[ \xa0]\S+|\|\|)|['’]s[ \xa0]{_ID_WORD}|['’]s[ \xa0](?:personal|n°|phone|number|house|e-?mail|address)|,[ \xa0](?:phone|tel|tél)|<br|\s*\[\[(?:user|benutzer|usuario|utilisateur):|$)"
)
_STARTS = re.compile(rf"(?i)(?:(?<!\w)(?:{_PERSON})|—|(?<!\S)\*|\|\|)[ \xa0]+(?=[^\W\d_])")
_ENDS = re.compile(rf"(?i)[ \xa0](?:{_DOING})(?!\w)|['’]s (?:{_ID_WORD}|personal|n°|phone|number|e-?mail|address)")
#: What doesn't follow people: coordinates, a year of description, an eponym's noun, the rest of a compound or link.
_NEVER = re.compile(r"(?i)^(?:[ \xa0]?\(-?\d+\.\d+|,[ \xa0]\d{4}\b|[ \xa0](?:index|method|test|theorem|syndrome|disease|effect|law|algorithm|equation|process|scale|constant|model|formula)\b|–\w|\]\]|\|(?!\|))")
_PLACE = {"bridge", "ridge", "bay", "glacier", "street", "road", "lane", "close", "avenue", "crescent", "river", "lake", "hill", "mount", "island", "park", "index", "user", "talk", "category", "bot"}
#: Labels and first words of sentences that may stand beside a name but seldom belong to one.
_LABELS = {
    "dr", "mr", "mrs", "ms", "prof", "hi", "haha", "holder", "inhaber", "titular", "titulaire", "signed", "the", "tel", "phone", "lost", "curator", "source", "quelle", "frau",
    "herr", "please", "you", "ich", "vivo", "écrire", "escribir", "bitte", "erreichbar", "contact", "contacto", "call", "lives", "at", "my", "email", "see", "revision",
    "accession", "catalogue", "isbn", "population", "sir", "miss", "hello", "dear", "name", "monsieur", "madame", "señor", "señora", "don", "doña",
}


@dataclass(frozen=True)
class Gazetteer:
    """Known parts of names, in lower case; an incomplete list."""

    given: frozenset[str]
    family: frozenset[str]

    def endings(self) -> frozenset[str]:
        """Last letters that several known family names have in common."""
        tails = Counter(w[-n:] for w in self.family for n in (2, 3, 4) if len(w) > n + 1)
        return frozenset(t for t, k in tails.items() if k >= max(3, len(self.family) / 60))


@dataclass
class Candidate:
    kind: int
    first: int
    last: int
    votes: list[int] = field(default_factory=list)
    marks: list[str] = field(default_factory=list)


_HINTS = {
    "email": ("@", "(at)", "[at]", "&#64;", " dot ", " at "),
    "en": tuple(f" {w}" for w in (*_STREET_EN, "rd", "ln", "ave", "av", "cres", "dr", "blvd", "sq", "gdns")),
    "fr": tuple(_STREET_FR),
    "es": tuple(_STREET_ES),
    "de": (*_STREET_DE, "am ", "an der ", "auf der ", "auf dem ", "zum ", "zur ", "beim "),
    "start": (
        "dr", "mr", "ms", "miss", "sir", "prof", "hr", "frau", "herr", "monsieur", "madame", "mme", "mlle", "señor", "sr", "don", "hi", "hello", "hey", "dear", "hallo", "liebe", "bonjour", "cher", "chère", "hola", "querid", "estimad",
        "holder", "owner", "inhaber", "titula", "au nom de", "signed", "gezeichnet", "signé", "firmado", "regards", "sincerely", "grüße", "cordialement", "saludos", "attn", "c/o", "name", "heiß", "appelle", "nommé", "llam", "nombre", "nom",
        "contact", "kontakt", "ansprechpartner", "ask", "talk", "speak", "spoke", "met", "meet", "thank", "phone", "ring", "write to", "wrote to", "written by", "edited by", "gespräch", "sprechen", "fragen", "wende", "bitte an", "écri", "entretien",
        "parl", "demande", "adressez", "escrib", "habla", "conversación", "entrevista", "pregunt", "colleague", "friend", "neighbo", "teacher", "boss", "manager", "brother", "sister", "mother", "father", "wife", "husband", "son ", "daughter",
        "uncle", "aunt", "cousin", "doctor", "patient", "student", "client", "customer", "author", "curator", "kolleg", "freund", "nachbar", "lehrer", "chef", "bruder", "schwester", "mutter", "vater", "kund", "collègue", "ami", "voisin",
        "frère", "sœur", "mère", "père", "colega", "amig", "vecin", "herman", "madre", "padre", "—", "* ", "|| ",
    ),
    "end": (
        " live", " said", " say", " wr", " work", " told", " asked", " called", " phoned", " emailed", " joined", " moved", " answered", " replied", " thinks", " added", " explained", " married", " teaches", " studies", " can be", " was born",
        " is a", " sagt", " schr", " wohnt", " arbeitet", " rief", " meinte", " heiratete", " ist err", " habit", " travaill", " dit", " écrit", " est né", " viv", " trabaja", " dijo", " escribió", " llamó", " nació", "'s ", "’s ",
    ),
}


class Scanner:
    """Finds candidates in a line; one pass for literal hints decides which patterns are tried."""

    def __init__(self, known: Gazetteer):
        import ahocorasick

        self.known = known
        self.endings = known.endings()
        self.literals = ahocorasick.Automaton()
        for hint, words in _HINTS.items():
            for w in words:
                self.literals.add_word(w, (hint, len(w)))
        for kind, names in (("family", known.family), ("given", known.given)):
            for w in names:
                self.literals.add_word(w, (kind, len(w)))
        self.literals.make_automaton()

    def candidates(self, line: str) -> list[Candidate]:
        """All candidate spans of one line with the votes of the labellers (1, -1 or 0 for no opinion) and their marks."""
        low = line.lower()
        if len(low) != len(line):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in line)
        hints: set[str] = set()
        spots: dict[str, list[int]] = {"given": [], "family": [], "start": [], "end": []}
        size_of_line = len(line)
        for end, (hint, size) in self.literals.iter(low):
            at = end - size + 1
            if hint == "email":
                hints.add(hint)
            elif hint == "end":
                spots[hint].append(at)
            elif hint == "start":
                if not at or not line[at].isalpha() or not line[at - 1].isalnum():
                    spots[hint].append(at)
            elif hint in spots:
                if line[at].isupper() and (not at or not line[at - 1].isalpha()) and (end + 1 == size_of_line or not line[end + 1].isalpha()):
                    spots[hint].append(at)
            elif hint not in hints and (end + 1 == size_of_line or not line[end + 1].isalpha() or line[end] == " ") and _house_near(line, hint, at, end + 1):
                hints.add(hint)
        found = _emails(line) if "email" in hints else []
        numbers = list(_DIGITS.finditer(line))
        if numbers:
            found += _numbers(line, numbers)
        styles = hints - {"email"}
        if styles:
            found += _addresses(line, styles)
        if any(spots.values()):
            found += _names(line, self, spots)
        return found


def _house_near(line: str, style: str, first: int, after: int) -> bool:
    """A digit where the house number of an address of this style would be."""
    if style in ("en", "fr"):
        return bool(_DIGIT.search(line, max(0, first - (90 if style == "en" else 14)), first))
    return bool(_DIGIT.search(line, after, after + (90 if style == "es" else 60)))


def _emails(line: str) -> list[Candidate]:
    found = []
    for m in _EMAIL.finditer(line):
        left = line[max(0, m.start() - 30) : m.start()]
        whole = m.group().lower()
        ending = re.search(r"([a-z]+)$", whole)[1]
        found.append(_candidate(line, 0, m.start(), m.end(), [
            1 if re.fullmatch(r"[a-z0-9._%+\-]+@[a-z0-9.\-]+", whole) else 0,
            1 if _MAIL_NEAR.search(left) else 0,
            -1 if re.search(r"(?i)(?:contig|accession|https?://\S*)[ \xa0]*$", left) else 1,
        ], ["ending=" + ending, "user" if "user:" in left.lower() else ""]))
    return found


def _numbers(line: str, spots: list[re.Match]) -> list[Candidate]:
    found: dict[tuple[int, int, int], Candidate] = {}
    for spot in spots:
        for kind, pattern, back in ((1, _PHONE, 2), (2, _ID, 3)):
            at, stop = max(0, spot.start() - back), spot.end()
            while at < stop:
                m = pattern.match(line, at) if not at or not _BEFORE.match(line[at - 1]) or line[at - 1] == "(" and line[at] != "(" else None
                if m is None:
                    at += 1
                    continue
                at = m.end()
                first, last = m.span()
                while line[first] in " \xa0.-‑–":
                    first += 1
                candidate = _number(line, kind, first, last)
                if candidate:
                    found[kind, first, last] = candidate
    return list(found.values())


def _number(line: str, kind: int, first: int, last: int) -> Candidate | None:
    """A telephone or identity number; either has six digits or more."""
    left, right = line[max(0, first - 70) : first], line[last : last + 50]
    shape = re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", line[first:last])))
    if sum(c == "9" for c in shape) < 6:
        return None
    labelled, near, after = bool(_ID_LABEL.search(left)), bool(_ID_NEAR.search(left)), bool(_ID_RIGHT.match(right))
    other = bool(_NUMBER_OTHER.search(left)) and not labelled
    if kind == 1:
        votes = [
            0 if re.fullmatch(r"9+", shape) else 1, 1 if _PHONE_NEAR.search(left) else 0, -1 if labelled or near or after else 0,
            -1 if other else 0, 1 if " ext" in line[first:last] or shape.startswith(("+", "(", "00")) else 0,
        ]
    else:
        strong = bool(_ID_STRONG.fullmatch(line[first:last]))
        plain = shape == "999999999"
        votes = [1 if strong else 0, 1 if labelled else 0, 1 if labelled or near or after else -1, 1 if after else 0, -1 if other else 0, -1 if plain and not labelled else 0]
    return _candidate(line, kind, first, last, votes, ["shape=" + shape])


def _addresses(line: str, styles: set[str]) -> list[Candidate]:
    found = []
    for pattern, style in _ADDRESS:
        if style not in styles:
            continue
        for m in pattern.finditer(line):
            first, last = m.span()
            street, town = m["street"], m["town"]
            if town and not _fits(street, town):
                last = line.rfind(",", m.end("street"), m.start("town"))
            proper = [w for w in re.findall(rf"{_L}+", street) if len(w) > 3]
            styled = (street.islower() or any(w[0].isupper() for w in proper)) and not _ARTICLE.match(street)
            left, right = line[max(0, first - 60) : first], line[last : last + 14]
            told = bool(_ADDRESS_LEFT.search(left))
            kind = (m["type"] or (m["type2"] if style == "de" else "") or "am").lower()
            vague = kind in _VAGUE or kind == "am" or kind in ("st", "st.") and first and not told
            other = re.match(r"(?i) (?:is|crosses|of|bridge)\b", right) or re.search(r"(?i)\b(?:in|of|since|route)[ \xa0]$", left) and not told
            found.append(_candidate(line, 3, first, last, [
                1 if styled else -1, 1 if told else 0, 1 if line[m.end("street") : last].strip(" ,.") else 0, -1 if other else 0, -1 if vague else 1,
            ], ["style=" + style]))
    return found


def _fits(street: str, town: str) -> bool:
    """A town is written like its street: small, large or with capitals."""
    if street.islower():
        return True
    return town[0].isupper()


def _names(line: str, scanner: Scanner, spots: dict[str, list[int]]) -> list[Candidate]:
    known = scanner.known
    seen: dict[tuple[int, int], Candidate] = {}

    def consider(first: int, last: int) -> None:
        text = line[first:last]
        if (first, last) in seen:
            return
        left, right = line[max(0, first - 30) : first], line[last : last + 46]
        words = [w for w in re.split(r"[ \xa0,.]+", text) if len(w) > 1]
        proper = [w for w in words if not _IS_PARTICLE(w.lower())]
        low = [p for w in proper for p in w.lower().split("-")]
        if len(proper) + len(re.findall(rf"{_L}\.", text)) < 2 or not proper:
            return
        place, label = any(w in _PLACE for w in low), any(w in _LABELS for w in low)
        capital = all(w[0].isupper() for w in proper)
        at_left, at_right = bool(_LEFT.search(left)), bool(_RIGHT.match(right))
        if not capital and not ((at_left or at_right) and all(w.islower() for w in proper)):
            return
        family_first = "," in text
        name = (proper[0] if family_first else proper[-1]).lower().split("-")[-1]
        others = [w.lower() for w in (proper[1:] if family_first else proper[:-1])]
        like = name in known.family or any(name.endswith(e) for e in scanner.endings)
        given = [w for w in others if w in known.given]
        # a family name among the given ones, or a given name in the family's place, speaks against the cut
        wrong = name in known.given or any(w in known.family or w not in known.given and w[-4:] in scanner.endings for w in others)
        initial = bool(re.search(rf"(?:^|[ \xa0.]){_L}\.", text))
        if not (at_left or at_right or given or name in known.family):
            return
        if not capital and not (given or name in known.family or like and (at_left or not right.lower().startswith((" is a", "\xa0is a")))):
            return
        case = "A" if text.isupper() else "a" if text.islower() else "Aa"
        seen[first, last] = _candidate(line, 4, first, last, [
            1 if given else 0, 1 if like else -1, 1 if at_left else 0, 1 if at_right else 0,
            -1 if place or _NEVER.match(right) or re.search(r"(?:\[\[|\w–|''|User:|(?<!\|)\|)$", left) else 0, -1 if wrong or label else 1 if initial else 0,
        ], ["end=" + name[-3:], "begin=" + low[0][-2:], "n=" + str(len(proper)), "case=" + case, "in=" + str(len(given)) + str(int(name in known.family))])

    def all_from(at: int) -> None:
        for end in _cuts(line, at, known):
            consider(at, end)
        if (n := _TURNED.match(line, at)) and _alike(*re.split(r",[ \xa0]", n.group(), maxsplit=1)):
            consider(at, n.end())
            if extra := re.match(rf"(?:{_GAP}{_L}\.)+", line[n.end() :]):
                consider(at, n.end() + extra.end())

    for at in spots["start"]:
        if m := _STARTS.match(line, at):
            all_from(m.end())
    for at in spots["end"]:
        if _ENDS.match(line, at):
            begin = max(0, at - 80)
            for n in re.finditer(rf"(?<![\w.])(?={_L})", line[begin:at]):
                head = line[begin + n.start() : at]
                if _TURNED.fullmatch(head) or _FULL.fullmatch(head):
                    consider(begin + n.start(), at)
    for at in spots["given"]:
        all_from(at)
        if b := re.search(rf"(?<![\w\-])({_FAMILY}),{_GAP}$", line[max(0, at - 60) : at]):
            all_from(max(0, at - 60) + b.start())
    for at in spots["family"]:
        for n in _HEADS.finditer(line, max(0, at - 60), at):
            all_from(n.start(1))
        all_from(at)
    return list(seen.values())


def _cuts(line: str, at: int, known: Gazetteer) -> list[int]:
    """Ends that a name beginning here may have: after its second word and after each that is written like it."""
    m = _NAME.match(line, at)
    if not m:
        return []
    text = m.group()
    first = re.match(rf"{_L}+", text)[0]
    initials = text[1:2] == "."
    upper, lower = len(first) > 1 and first.isupper(), not initials and first.islower()
    out, end = [], at + re.match(rf"(?i){_INITIALS}|{_L}+", text).end()
    for _ in range(5):
        n = _NEXT.match(line, end)
        if not n:
            break
        word = n[1]
        if re.fullmatch(rf"(?:{_L}\.)+", word):
            end = n.end()
            continue
        if _IS_PARTICLE(word.lower()):
            end = n.end()
            continue
        if upper and not word.isupper() or lower and not word.islower() or not (upper or lower) and not word[0].isupper():
            break
        end = n.end()
        out.append(end)
        if lower and len(out) == 2 or len(out) == 3:
            break
    return out


def _alike(a: str, b: str) -> bool:
    if a.islower() or b.islower():
        return a.islower() == b.islower()
    return True


def _candidate(line: str, kind: int, first: int, last: int, votes: list[int], marks: list[str]) -> Candidate:
    left = re.findall(r"\w+|[^\w\s]", line[max(0, first - 20) : first])
    right = re.findall(r"\w+|[^\w\s]", line[last : last + 20])
    near = ["l=" + (left[-1].lower() if left else "^"), "l2=" + (left[-2].lower() if len(left) > 1 else "^"), "r=" + (right[0].lower() if right else "$"), "r2=" + (right[1].lower() if len(right) > 1 else "$")]
    return Candidate(kind, first, last, votes, marks + near + [f"v{i}={v}" for i, v in enumerate(votes)])


def _pack_votes(votes: list[int]) -> int:
    packed = 0
    for v in reversed(votes + [0] * (6 - len(votes))):
        packed = packed * 3 + v + 1
    return packed


def _unpack_votes(packed: int) -> np.ndarray:
    out = []
    for _ in range(6):
        out.append(packed % 3 - 1)
        packed //= 3
    return np.array(out)


def _slots(kind: int, marks: list[str]) -> list[int]:
    return sorted({zlib.crc32(f"{kind}:{m}".encode()) % WIDTH for m in [*marks, "always"] if m})


def _extractor(known: Gazetteer, texts: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kinds = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(known)
        remembered: dict[str, tuple] = {}
        for batch in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, at = [], 0
                for line in (text.as_py() or "").split("\n"):
                    got = remembered.get(line)
                    if got is None:
                        got = remembered[line] = tuple((c.kind, c.first, c.last, _pack_votes(c.votes), _slots(c.kind, c.marks)) for c in scanner.candidates(line))
                    rows += [(k, at + a, at + b, v, m) for k, a, b, v, m in got]
                    at += len(line) + 1
                if len(remembered) > REMEMBER:
                    remembered.clear()
                if rows or texts:
                    out[0].append(doc)
                    for i, column in enumerate(zip(*rows, strict=True) if rows else [()] * 5, 1):
                        out[i].append(list(column))
                    out[6].append(text.as_py())
            columns = [pa.array(out[0], pa.int64()), *(pa.array(c, kinds) for c in out[1:5]), pa.array(out[5], pa.list_(kinds))]
            names = ["doc_id", "kind", "first", "last", "votes", "marks"]
            yield pa.record_batch([*columns, pa.array(out[6], pa.string())] if texts else columns, names=[*names, "text"] if texts else names)

    return run


#: Expected shares of the votes -1, 0 and 1 for an item and for anything else; they weigh as much as this part of the candidates.
_EXPECTED = (np.array([0.05, 0.45, 0.5]), np.array([0.45, 0.5, 0.05]))
_EXPECTED_WEIGHT = 0.2


def reliabilities(counts: dict[tuple[int, int], int], rounds: int = 50) -> dict[tuple[int, int], float]:
    """The chance that a candidate is an item, for every (kind, votes), by expectation-maximisation over all candidates.

    Each labeller has, for items and for others, its own chances of voting 1, -1 or 0; these and the share of items
    are estimated in turn with the chances of the vote patterns. Labellers count as independent given the truth, and
    as better than guessing to begin with, so that two spellings of an item are not taken for item and other.
    """
    out = {}
    for kind in {k for k, _ in counts}:
        patterns = [v for k, v in counts if k == kind]
        n = np.array([counts[kind, v] for v in patterns], float)
        votes = np.stack([_unpack_votes(v) for v in patterns]) + 1
        yes0, no0 = (e * (_EXPECTED_WEIGHT * n.sum() + 2) for e in _EXPECTED)
        belief = 1 / (1 + np.exp(-1.5 * (votes - 1).sum(axis=1)))
        for _ in range(rounds):
            prior = ((n * belief).sum() + 2) / (n.sum() + 4)
            score = np.full(len(n), np.log(prior / (1 - prior)))
            for j in range(votes.shape[1]):
                seen = np.eye(3)[votes[:, j]]
                yes = (seen * (n * belief)[:, None]).sum(axis=0) + yes0
                no = (seen * (n * (1 - belief))[:, None]).sum(axis=0) + no0
                score += np.log(yes / yes.sum())[votes[:, j]] - np.log(no / no.sum())[votes[:, j]]
            belief = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        out |= {(kind, v): float(b) for v, b in zip(patterns, belief, strict=True)}
    return out


def train(marks: list[list[int]], targets: np.ndarray, steps: int = 150) -> np.ndarray:
    """Weights of a logistic span classifier on the labellers' chances."""
    if not marks:
        return np.zeros(WIDTH)
    rows = np.repeat(np.arange(len(marks)), [len(m) for m in marks])
    cols = np.concatenate([np.asarray(m) for m in marks])
    weights, memory = np.zeros(WIDTH), np.full(WIDTH, 1e-6)
    for _ in range(steps):
        chance = 1 / (1 + np.exp(-np.clip(np.bincount(rows, weights[cols], len(marks)), -30, 30)))
        slope = np.bincount(cols, (chance - targets)[rows], WIDTH) / len(marks) + 1e-5 * weights
        memory += slope**2
        weights -= 0.5 * slope / np.sqrt(memory)
    return weights


def _gazetteer(name_parts: DataFrame) -> Gazetteer:
    """The list of name parts is a small table of fixed size; every task holds it."""
    rows = name_parts.select(F.lower("part_text"), "part_kind").filter("part_text is not null").collect()
    return Gazetteer(frozenset(t for t, k in rows if k == "given"), frozenset(t for t, k in rows if k == "family"))


def fit(documents: DataFrame, name_parts: DataFrame, sample: int = SAMPLE, texts: bool = False) -> tuple[np.ndarray, DataFrame]:
    """Train on all documents (doc_id, text): the span classifier's weights and the durable table of all candidates.

    The table has a row for each document with candidates or, with ``texts``, for each document, and then its text.

    Labellers (formats, gazetteer, words around) vote on every candidate of every whole text. Their reliabilities
    come from the counts of all vote patterns; a logistic classifier is then trained on the resulting chances of at
    most ``sample`` candidates, chosen by a hash.
    """
    ws = Workspace(documents.sparkSession, "personal")
    known = _gazetteer(name_parts)
    rows = ws.save(documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_extractor(known, texts), _ROWS + (", text string" if texts else "")))
    each = rows.select("doc_id", F.explode(F.arrays_zip("kind", "first", "votes", "marks")).alias("c")).select("doc_id", "c.*")
    counts = {(r[0], r[1]): r[2] for r in each.groupBy("kind", "votes").count().collect()}  # at most 3**6 patterns a kind
    belief = reliabilities(counts)
    total = sum(counts.values())
    order = F.xxhash64("doc_id", "first", "kind")
    if total > sample:  # about 1.2 times the sample, then its smallest hashes
        each = each.filter(F.pmod(order, F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.2 * sample / total)))
    chosen = each.select("kind", "votes", "marks", order.alias("_o")).orderBy("_o").limit(sample).collect()
    weights = train([r["marks"] for r in chosen], np.array([belief[r["kind"], r["votes"]] for r in chosen]))
    return weights, rows


def _choose(weights: np.ndarray, rows: list[tuple]) -> list[tuple[int, int, int]]:
    """The spans that the classifier accepts; of overlapping ones the surer, then the longer, stays (names of some certainty go by length)."""
    scored = []
    for kind, first, last, marks in rows:
        if (score := float(weights[marks].sum())) > 0:
            scored.append((-min(score, 2.0 if kind == 4 else 6.0), first - last, first, last, kind))
    taken: list[tuple[int, int, int]] = []
    for _, _, first, last, kind in sorted(scored):
        if all(last <= a or first >= b for _, a, b in taken):
            taken.append((kind, first, last))
    return sorted(taken, key=lambda t: t[1])


def find_personal(documents: DataFrame, name_parts: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Personal items of each text: doc_id, kind, start_pos, end_pos (code points from 1, both included).

    Null and empty texts have no rows. Repeated texts are searched once in a task and found in each document.
    """
    weights, rows = fit(documents, name_parts, sample)

    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            table = batch.to_pydict()
            for doc, *columns in zip(table["doc_id"], table["kind"], table["first"], table["last"], table["marks"], strict=True):
                out += [(doc, KINDS[k], a + 1, b) for k, a, b in _choose(weights, list(zip(*columns, strict=True)))]
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32())], names=["doc_id", "kind", "start_pos", "end_pos"])

    return rows.select("doc_id", "kind", "first", "last", "marks").mapInArrow(accept, FOUND)


def mask_personal(documents: DataFrame, name_parts: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The texts with a typed placeholder such as [EMAIL] for each item, otherwise unchanged: doc_id, text, items.

    One row for each document; null texts stay null with 0 items. Texts are searched once and never shuffled: they
    stand beside their candidates in the durable table until the classifier is trained.
    """
    weights, rows = fit(documents, name_parts, sample, texts=True)

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, items = [], []
            table = batch.to_pydict()
            for text, *columns in zip(table["text"], table["kind"], table["first"], table["last"], table["marks"], strict=True):
                spans = _choose(weights, list(zip(*columns, strict=True)))
                at, parts = 0, []
                for kind, first, last in spans:
                    parts += [text[at:first], f"[{KINDS[kind].upper()}]"]
                    at = last
                texts.append("".join([*parts, text[at:]]) if parts else text)
                items.append(len(spans))
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(items, pa.int32())], names=["doc_id", "text", "items"])

    return rows.select("doc_id", "kind", "first", "last", "marks", "text").mapInArrow(mask, "doc_id bigint, text string, items int")
