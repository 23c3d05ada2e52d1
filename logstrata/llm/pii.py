"""Personal information in free text, by a semi-Markov conditional random field.

Whole spans are scored: a candidate span with a type (email, phone, id_number, address, name)
has features of its shape as a whole, of its words in a name lexicon and of what stands left
and right of it. Segments that have the shape of no type are not scored; of the rest a dynamic
program over span ends chooses the set of non-overlapping spans and types with the highest
total score. Bounds of an entity are those of its kind (digits of a number, words of a name),
not of its characters. Cheap tests for a character or a word that a kind of span cannot do
without go before its pattern.
The weights are fitted by conditional log-likelihood (forward-backward over the same lattice)
on `TRAIN_TEXTS` generated, labelled texts; nothing of the driver's tables is used for that.

Defined results: null and empty texts have no mentions (`redact` returns them as they are),
documents without id none that could be reported; texts of any length are read whole;
overlapping candidates never both win; equal scores prefer the span that ends first, then the
longer one; a lexicon of more than `MAX_LEXICON` names is refused, as it is held by every task.
"""

from __future__ import annotations

import math
import random
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TYPES = ("email", "phone", "id_number", "address", "name")
TRAIN_TEXTS = 600
MAX_LEXICON = 1_000_000
LEFT, RIGHT = 48, 20
#: What speaks for a name stands right before it.
LEFT_OF_NAME = 24

# --- candidate spans: fixed patterns of shapes -----------------------------------------
_AT = r"(?:@|\s?[\[(]at[\])]\s?)"
_DOT = r"(?:\.|\s?[\[(]dot[\])]\s?)"
EMAIL = re.compile(rf"[A-Za-z0-9][A-Za-z0-9._%+-]*{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*", re.I)
EMAIL_FULL = re.compile(rf"[\w][\w.%+-]*{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}}", re.I)
SPELLED = re.compile(r"\b([a-z0-9][\w.+-]*) (?:at|AT) ([a-z0-9-]+(?: (?:dot|DOT) [a-z0-9-]+)+)\b", re.I)
EXTENSION = r"(?:,?\s?(?:ext\.?|extension|x|Durchwahl|máy lẻ)\s?\d{1,5})"
DIGITS = re.compile(rf"(?<![\w.+/:@-])[+(]?\d[\d().\-/\u2011 \u00a0]{{4,22}}\d{EXTENSION}?(?![\w@])")
ALNUM = re.compile(r"(?<![\w-])(?:[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[A-Z]{1,3}\d{6,9}[A-Z]?)(?![\w-])")
STREETS = ("Street", "St", "Road", "Rd", "Avenue", "Ave", "Boulevard", "Blvd", "Lane", "Ln", "Drive", "Dr", "Close", "Court", "Ct", "Way", "Place", "Square", "Terrace", "Crescent", "Row", "Parade", "Gardens", "Grove", "Hill", "Mews", "Walk")
ABBREVIATED = ("St", "Rd", "Ave", "Blvd", "Ln", "Dr", "Ct")
CAPS = r"(?:[A-ZÀ-ÖØ-ÞĐ][\w'’.-]*)"
ADDRESS_EN = re.compile(rf"(?:\b(?:No|Nr|Number|Unit)\.? ?)?(?<![\w.:/-])\d{{1,5}}[A-Za-z]?(?:-\d{{1,5}})? (?:{CAPS} ){{1,12}}?(?:{'|'.join(STREETS)})\b(?! (?:{'|'.join(STREETS)})\b)")
#: The full stop of an abbreviation, where the sentence goes on.
STOP = re.compile(r"\.(?=,| [a-zà-ÿ])")
STREET_DE = ("weg", "straße", "strasse", "str.", "gasse", "stieg", "steig", "platz", "allee", "ring", "damm", "ufer", "grund", "hof", "markt")
LEAD_DE = ("Am", "An der", "An den", "Im", "In der", "Zum", "Zur", "Auf der", "Auf dem", "Unter den", "Alte", "Alter", "Altes", "Neue", "Neuer", "Neues")
_DE = "|".join(x.replace(".", r"\.") for x in STREET_DE)
_DE_WORD = "|".join(x.capitalize().replace(".", r"\.") for x in STREET_DE)
ADDRESS_DE = re.compile(rf"(?:\b(?:{'|'.join(LEAD_DE)}) [A-ZÄÖÜ][\wäöüß-]+|\b[A-ZÄÖÜ][\wäöüß-]*(?:{_DE})|\b[A-ZÄÖÜ][\wäöüß-]+ (?:[A-ZÄÖÜ]?[\wäöüß-]+(?:{_DE})|{_DE_WORD})) \d{{1,4}}(?: ?[a-z])?(?![\w:]|\.\d)")
CLUES_DE = tuple(f"{x} " for x in (*STREET_DE, *(y.capitalize() for y in STREET_DE), *LEAD_DE))
ADDRESS_VI = re.compile(r"\b(?:[Ss]ố(?: nhà)? )?\d{1,4}[A-Za-z]?(?:/\d{1,4})* (?:đường|phố|ngõ|hẻm|đại lộ) (?:[A-ZÀ-ỸĐ]\w*)(?: [A-ZÀ-ỸĐ0-9]\w*){0,4}")
CLUES_VI = ("đường", "phố", "ngõ", "hẻm", "đại lộ")
WORD = re.compile(r"[^\W\d_][^\W\d_'’]*(?:['’-][^\W\d_]+)*\.?")
_UPPER = "A-Z" + "".join(c for c in map(chr, range(0xC0, 0x2000)) if c.isupper())
CAPITAL = re.compile(rf"[{_UPPER}](?<!\w.)(?<![^\W\d_][-'’].)[^\W\d_'’]*(?:['’-][^\W\d_]+)*\.?")
LOWER = re.compile(r"[a-z\u00df-\u1eff]{2,}")

# --- context: words that speak for a kind of number, place or person -------------------
CUES = {
    "phone": r"phone|\btel\b|tel[.:=]|call|reach|callback|dial|mobile|\bfax|hotline|rückruf|ruf|erreichbar|telefon|điện thoại|gọi|\bsố điện|shift at|\bunter\b|\bunder\b",
    "id": r"\bssn\b|\bni (?:number|no)|social security|insurance|passport|personal id|\btax\b|steuer|cccd|cmnd|căn cước|citizen|ausweis|\breisepass|hộ chiếu|thuế|national|identity|\bid ?(?:=|is|no|number)|licen[cs]e|nhs|sozialversicherung",
    "code": r"\b(?:serial|ticket|order|counter|offset|trace|version|release|limit|window|partition|lane|cage|tile|chunk|block|commit|template|port(?=\W*$)|build|parcel no|sku|rev|run of|queue|swap|epoch|seq)\b",
    "place": r"address|courier|parcel|ship|send|sent|deliver|went to|\bto$|geht an|liefer|adresse|wohnt|lives|gửi|địa chỉ|rang at|office|moved to|visit",
    "person": r"(?:\bby|from|ask|asks|owner\W*|assignee\W*|contact\W*|name is|lists|request for|tonight:|shift:|\bmr\.?|\bmrs\.?|\bms\.?|\bdr\.?|prof\.?|herr|frau|von|bei|steht|của|là|cáo:|hệ|ông|bà|asked for|thanks to|according to|handover|->|--|cc|dear|hi|regards,|user|nach|an|für|cho|và|and|with|to|for)\W*$",
}
_CUES = lambda *kinds: re.compile("|".join(f"(?P<{k}>{CUES[k]})" for k in kinds), re.I)
CUES_OF = {"name": _CUES("person"), "address": _CUES("place", "code"), "email": _CUES("phone", "id", "code"), "phone": _CUES("phone", "id", "code"), "id_number": _CUES("phone", "id", "code")}
AFTER_PERSON = re.compile(r"^\W*(?:wrote|said|says|hat|was|is\b|asked|took|called|approved|->|\(|,|;|qua|là|at \d|and my|\|?$)", re.I)
PRODUCT = re.compile(r"^[\s-]*(?:release|exporter|format|server|rack|build|version|patch|driver|cluster|protocol|standard|street|road|avenue|lane|cabling|node|parser|module|\d)", re.I)
MACHINE = re.compile(r"\b(?:rack|the|release|node|host|server|module|package)\s*$", re.I)


_folded: dict[str, str] = {}


def fold(word: str) -> str:
    """Case and accents removed."""
    if word in _folded:
        return _folded[word]
    if len(_folded) > 100_000:
        _folded.clear()
    _folded[word] = out = _fold(word)
    return out


def _fold(word: str) -> str:
    word = word.casefold().replace("đ", "d").replace("ø", "o").replace("ł", "l").replace("’", "'")
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


Span = tuple[int, int, str, list[str]]


def _shape(digits: str) -> str:
    return re.sub(r"\d+", lambda m: str(len(m[0])), LAST_EXTENSION.sub("", digits))


IPV4 = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}(?:/\d+)?")
SENTENCE = re.compile(r".*[^\W\d_]{3}[.!?;]\s+(?=[^\W\d_a-z])", re.S)
LAST_EXTENSION = re.compile(EXTENSION + "$")
NI = re.compile(r"[A-Z]{2}[\d ]+[A-D]")
LOCAL = re.compile(r"\d{3}[-. ]\d{4}$")
CLUE_EN = re.compile(rf" (?:{'|'.join(STREETS)})\b")
PHONE_SHAPES = {
    "local": re.compile(r"^3[-. ]4$"),
    "clock": re.compile(r"^6 6"),
    "nanp": re.compile(r"^(?:3[-. ]3[-. ]4|\(3\) ?3[-. ]4|1[-. ]3[-. ]3[-. ]4)$"),
    "plus": re.compile(r"^\+"),
    "zeros": re.compile(r"^[45][-. ]"),
    "trunk": re.compile(r"^[3-5][ -]\d[ -]?\d?[ -]?\d?$"),
}
ID_SHAPES = {"3-2-4": re.compile(r"^3[- ]2[- ]4$"), "2 3 3 3": re.compile(r"^2 3 3 3$|^11$"), "12": re.compile(r"^12$"), "10-2": re.compile(r"^(?:10|9|8)-[12]$|^10$")}


def _numbers(text: str) -> Iterator[Span]:
    for m in DIGITS.finditer(text):
        whole, s, e = m[0], m.start(), m.end()
        if whole.count(".") == 3 and IPV4.fullmatch(whole):
            continue
        cut = LAST_EXTENSION.search(whole)
        n = sum(map(str.isdigit, whole[: cut.start()] if cut else whole))
        if not 7 <= n <= 15 or (n == 7 and not LOCAL.match(whole)):
            continue
        shape = _shape(whole)
        spans = [(s, e)] + ([(s, s + cut.start())] if cut else [])
        for a, b in spans:
            part = text[a:b]
            feats = ["ext_kept" if cut and b == e else "ext_left" if cut else "no_ext"]
            for name, pattern in PHONE_SHAPES.items():
                if pattern.search(shape):
                    ok = name != "zeros" and name != "trunk" or part.startswith("00" if name == "zeros" else "0")
                    feats.append(name if ok else name + "_no")
            yield a, b, "phone", feats + [f"digits_{'local' if n == 7 else 'few' if n < 9 else 'some' if n < 13 else 'many'}"]
            if not cut and n > 7:
                yield a, b, "id_number", [k for k, p in ID_SHAPES.items() if p.search(shape)] or ["other_shape"]
    for m in ALNUM.finditer(text):
        yield m.start(), m.end(), "id_number", ["letters_ni" if NI.fullmatch(m[0]) else "letters"]


def _names(text: str, given: set[str], family: set[str]) -> Iterator[Span]:
    """Two to four words that may be a name; words of a name begin with capitals or are in the lexicon."""
    lower = {w for w in set(LOWER.findall(text)) if (f := w if w.isascii() else fold(w)) in given or f in family}
    tokens = [(m.start(), m.end(), m[0]) for m in (WORD if lower else CAPITAL).finditer(text)]
    known: dict[int, str] = {}
    for k, (s, e, w) in enumerate(tokens):
        bare = w.rstrip(".")
        if len(bare) == 1:
            if w.endswith(".") and bare.isupper():
                known[k] = "i"
        elif w[0].isupper() or bare in lower:
            f = fold(bare)
            if f in given or f in family:
                known[k] = "b" if f in given and f in family else "g" if f in given else "f"
            elif w[0].isupper():
                known[k] = "u"
    for k in known:
        gaps: list[str] = []
        for size in (2, 3, 4):
            j = k + size - 1
            # words stand close by; a full stop ends a name except after an initial
            if j not in known or (tokens[j - 1][2].endswith(".") and known[j - 1] != "i"):
                break
            gaps.append(text[tokens[j - 1][1] : tokens[j][0]])
            if gaps[-1].strip() not in ("", ",") or len(gaps[-1]) > 3 or "\n\n" in gaps[-1] or (size > 2 and gaps[-1].strip() == ","):
                break
            kinds = "".join(known[j] for j in range(k, k + size))
            end = tokens[j]
            stop = end[1] - (end[2].endswith(".") and known[j] != "i")
            comma = gaps[0].strip() == ","
            order = "reverse" if comma else "plain"
            first, last = (kinds[1:], kinds[0]) if comma else (kinds[:-1], kinds[-1])
            if not comma and kinds[0] == "f" and kinds[-1] in "gb":
                order, first, last = "swapped", kinds[::-1][:-1], kinds[0]
            initials = size == 3 and (kinds[1] == "i" or (comma and kinds[2] == "i"))
            if last == "i" or (size > 2 and not initials and (comma or "\n" in "".join(gaps) or "i" in kinds[1:])):
                continue
            lead = first[0]
            a = "given" if lead in "gb" else "initial" if lead == "i" else "other"
            b = "family" if last in "fb" else "other"
            if a != "given" and b != "family":
                if order == "reverse" or a == "initial" or size > 2 or not (tokens[k][2].isalpha() and end[2].rstrip(".").isalpha()):
                    continue
            yield tokens[k][0], stop, "name", [f"{order}_{a}_{b}", "two" if size == 2 else "middle" if initials else f"long_{a}_{b}"]


def _emails(text: str) -> Iterator[Span]:
    low = text.lower()
    if "@" in text or "at)" in low or "at]" in low:
        for m in EMAIL.finditer(text):
            full = EMAIL_FULL.match(text, m.start())
            if full:
                yield full.start(), full.end(), "email", ["plain" if "@" in full[0] else "spelled"]
            else:
                yield m.start(), m.end(), "email", ["no_domain"]
    if " at " in low and " dot " in low:
        for m in SPELLED.finditer(text):
            yield m.start(), m.end(), "email", ["words"]


def _addresses(text: str) -> Iterator[Span]:
    if CLUE_EN.search(text):
        for m in ADDRESS_EN.finditer(text):
            stop = STOP.match(text, m.end()) if m[0].endswith(ABBREVIATED) else None
            yield m.start(), stop.end() if stop else m.end(), "address", ["en"]
    for kind, clues, pattern in (("de", CLUES_DE, ADDRESS_DE), ("vi", CLUES_VI, ADDRESS_VI)):
        if any(x in text for x in clues):
            for m in pattern.finditer(text):
                yield m.start(), m.end(), "address", [kind]


def _nearest(cues: re.Pattern, left: str) -> str | None:
    """The kind of the last cue on the left."""
    kind = None
    for m in cues.finditer(left):
        kind = m.lastgroup
    return kind


def candidates(text: str, given: set[str], family: set[str]) -> list[Span]:
    """Candidate spans with their features, ordered by their end."""
    out = [*_emails(text), *_numbers(text), *_addresses(text), *_names(text, given, family)]
    spans = []
    for s, e, kind, feats in out:
        line = text.rfind("\n", 0, s) + 1
        left, right = text[max(line, s - (LEFT_OF_NAME if kind == "name" else LEFT)) : s], text[e : e + RIGHT]
        if before := SENTENCE.match(left):
            left = left[before.end() :]
        feats = [f"{kind}:{f}" for f in feats]
        # of several cues the one next to the span counts
        if cue := _nearest(CUES_OF[kind], left):
            feats.append(f"{kind}<{cue}")
        if kind == "name":
            feats += ["name>person"] * bool(AFTER_PERSON.match(right)) + ["name>product"] * bool(PRODUCT.match(right)) + ["name<machine"] * bool(MACHINE.search(left))
            feats += ["name:in_word"] * bool(re.match(r"[@\w]", right) or re.search(r"[\w@._-]$", left))
            feats += ["name:line_start"] * (not left.strip(" \t|>*-"))
        if kind in ("phone", "id_number"):
            feats += [f"{kind}:line_start"] * (not left.strip(" \t|>*-"))
            feats += [f"{kind}:alone"] * (not left.strip() and not right.split("\n")[0].strip())
            feats += [f"{kind}:joined"] * bool(re.match(r"[-./]?\d", right) or re.search(r"\d[-./]?$", left))
        spans.append((s, e, kind, [f"{kind}:bias", *feats]))
    return sorted(spans, key=lambda x: (x[1], x[0] - x[1]))


def _score(weights: dict[str, float], span: Span) -> float:
    return sum(weights.get(f, 0.0) for f in span[3])


def decode(spans: list[Span], weights: dict[str, float]) -> list[tuple[int, int, str]]:
    """The best set of non-overlapping spans: Viterbi over span ends."""
    ends = sorted({s[1] for s in spans})
    best: list[tuple[float, Span | None, int]] = [(0.0, None, -1)]
    index = {e: k + 1 for k, e in enumerate(ends)}
    by_end: dict[int, list[Span]] = {}
    for s in spans:
        by_end.setdefault(s[1], []).append(s)
    for k, e in enumerate(ends, 1):
        top = (best[k - 1][0], None, k - 1)
        for s in by_end[e]:
            before = _before(ends, s[0])
            value = best[before][0] + _score(weights, s)
            if value > top[0] + 1e-9:
                top = (value, s, before)
        best.append(top)
    out, k = [], len(ends)
    while k > 0:
        _, span, before = best[k]
        if span:
            out.append((span[0], span[1], span[2]))
        k = before
    assert len(index) == len(ends)
    return out[::-1]


def _before(ends: list[int], start: int) -> int:
    """How many ends lie at or before `start`."""
    lo, hi = 0, len(ends)
    while lo < hi:
        mid = (lo + hi) // 2
        if ends[mid] <= start:
            lo = mid + 1
        else:
            hi = mid
    return lo


# --- training ---------------------------------------------------------------------------
def _lse(a: float, b: float) -> float:
    m = max(a, b)
    return m + math.log(math.exp(a - m) + math.exp(b - m))


def gradient(spans: list[Span], gold: set[tuple[int, int, str]], weights: dict[str, float], grad: dict[str, float]) -> None:
    """Adds observed minus expected feature counts of one text."""
    ends = sorted({s[1] for s in spans})
    slot = {e: k + 1 for k, e in enumerate(ends)}
    arcs = [(_before(ends, s[0]), slot[s[1]], _score(weights, s), s) for s in spans]
    n = len(ends)
    into: list[list] = [[] for _ in range(n + 1)]
    for arc in arcs:
        into[arc[1]].append(arc)
    alpha = [0.0] * (n + 1)
    for k in range(1, n + 1):
        alpha[k] = alpha[k - 1]
        for b, _, score, _s in into[k]:
            alpha[k] = _lse(alpha[k], alpha[b] + score)
    beta = [-math.inf] * (n + 1)
    beta[n] = 0.0
    for k in range(n, 0, -1):
        beta[k - 1] = beta[k] if beta[k - 1] == -math.inf else _lse(beta[k - 1], beta[k])
        for b, _, score, _s in into[k]:
            beta[b] = beta[k] + score if beta[b] == -math.inf else _lse(beta[b], beta[k] + score)
    for b, e, score, s in arcs:
        p = math.exp(min(0.0, alpha[b] + score + beta[e] - alpha[n]))
        d = ((s[0], s[1], s[2]) in gold) - p
        for f in s[3]:
            grad[f] = grad.get(f, 0.0) + d


_SYLLABLES = ["bal", "ken", "dor", "mir", "sal", "ven", "tor", "lin", "gar", "hes", "pol", "ric", "ana", "bor", "cel", "dam", "fen", "jor", "kal", "lev"]


def training_texts(n: int = TRAIN_TEXTS, seed: int = 7) -> tuple[list[tuple[str, set[tuple[int, int, str]]]], set[str], set[str]]:
    """Generated texts with labelled spans, and the lexicon their names come from."""
    rng = random.Random(seed)
    invent = lambda k: "".join(rng.choice(_SYLLABLES) for _ in range(k)).capitalize()
    given, family = [invent(2) for _ in range(40)], [invent(3) for _ in range(40)]
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    area = lambda: rng.choice("23456789") + digits(2)

    def name() -> str:
        g, f = rng.choice(given), rng.choice(family)
        s = rng.choice([f"{g} {f}", f"{g} {f}", f"{g[0]}. {f}", f"{f}, {g}", f"{g} {rng.choice('ABCKLR')}. {f}", f"{g} {invent(2)} {f}" if rng.random() < 0.4 else f"{f} {g}"])
        return s.upper() if rng.random() < 0.1 else s

    def phone() -> str:
        base = rng.choice([f"+1 {area()} {area()} {digits(4)}", f"({area()}) {area()}-{digits(4)}", f"{area()}-{area()}-{digits(4)}", f"1.{area()}.{area()}.{digits(4)}", f"+44 20 {digits(4)} {digits(4)}", f"0{digits(4)} {digits(6)}", f"+49 30 {digits(5)} {digits(3)}", f"0049-30-{digits(8)}", f"+1{digits(10)}", f"+84 {digits(2)} {digits(3)} {digits(4)}", f"555-{digits(4)}" if rng.random() < 0.5 else f"555 {digits(4)}"])
        return base + (f" ext. {digits(3)}" if rng.random() < 0.12 else "")

    def id_number() -> str:
        return rng.choice([f"{digits(3)}-{digits(2)}-{digits(4)}", f"{digits(3)} {digits(2)} {digits(4)}", f"QX{digits(6)}B", f"QX {digits(2)} {digits(2)} {digits(2)} B", f"XK{digits(7)}", digits(12), f"{digits(2)} {digits(3)} {digits(3)} {digits(3)}", digits(11), f"{digits(10)}-{digits(2)}"])

    def address() -> str:
        n_ = str(rng.randint(1, 300)) + rng.choice(["", "", "B"])
        return rng.choice([f"{n_} {invent(2)} {rng.choice(['Street', 'Road', 'Lane', 'Avenue', 'Drive'])}", f"{n_} Old {invent(2)} Way", f"{invent(2)}weg {n_.lower()}", f"{invent(3)}er Straße {n_.lower()}", f"Am {invent(3)} {n_.lower()}", f"số {n_} đường {invent(1)} {invent(1)}"])

    def email() -> str:
        u = rng.choice(given).lower() + rng.choice([".", "_", ""]) + rng.choice(family).lower() + rng.choice(["", digits(2)])
        d = rng.choice(["example.com", "mail.example.net", "corp.test"])
        return rng.choice([f"{u}@{d}", f"{u}@{d}", f"{u} (at) {d}", f"{u}[at]{d.replace('.', '[dot]')}"])

    makers = {"name": name, "phone": phone, "id_number": id_number, "address": address, "email": email}
    positive = [
        "Reported by {name}, phone {phone}.", "Please ask {name} ({email}) before you start.", "Owner: {name}", "| phone | {phone} |", "call me under {phone} or write to {email}",
        "My name is {name} and my SSN is {id_number}.", "passport no. {id_number} of {name}", "The card lists {name}, national insurance no. {id_number}.", "{name} wrote: restart it.",
        "thanks to {name} for the look", "Send the box to {address}, Newtown.", "The courier rang at {address} and asked for {name}.", "Das Paket geht an {address}, 12345 Altdorf.",
        "Gửi hàng đến {address}.", "Số CCCD của {name} là {id_number}.", "Auf dem Antrag steht {name}, Steuer-ID {id_number}.", "Gemeldet von {name}, erreichbar unter {phone}.", "Người báo cáo: {name}, điện thoại {phone}.",
        "cc {email}; {email}", "row: id={id_number};mail={email};tel={phone}", "{phone}", "{email}", "Handover {name} -> {name} at 10:20:30.", '{{"assignee": "{name}", "callback": "{phone}"}}', "-- {name}", "{name} Ops", "call {name} at {phone}", "According to {name} Backend 3 was slow.", "my NI number is {id_number}", "dial {phone} now",
    ]
    negative = [
        lambda: f"Serial {digits(3)}-{digits(3)}-{digits(4)} is on the unit.", lambda: f"Trace number {digits(12)} shows up.", lambda: f"Offset {digits(12)} of partition 3 was read.", lambda: f"Ticket {digits(4)}-{digits(2)}-{digits(4)} and order {digits(4)}-{digits(4)}-{digits(3)} match.",
        lambda: f"watch counter {digits(3)}.{digits(3)}.{digits(4)} now", lambda: f"Set limit={digits(10)} and window={digits(3)}.", lambda: f"The {rng.choice(given)} release reads the {rng.choice(family)} format.", lambda: f"The {rng.choice(given)} {rng.choice(family)} exporter was moved.",
        lambda: f"Rack {rng.choice(given)}-{digits(2)} moved.", lambda: f"git@mirror-{digits(2)}:ops/x.git was archived.", lambda: f"amqp://svc:***@queue-{digits(2)}:5672/x", lambda: f"See section {digits(2)} of {invent(2)} Street Standard.",
        lambda: f"Version {digits(1)}.{digits(2)}.{digits(2)} of the parser drops {digits(3)} lines.", lambda: f"server {digits(3)}-{digits(2)}-{digits(4)} build", lambda: f"{invent(2)} {invent(2)} was slow and Check {invent(2)} again.", lambda: f"{digits(6)} {digits(6)} {digits(3)} DEBUG x.y: moved", lambda: f"step {digits(3)}-{digits(4)} of batch {digits(3)} {digits(4)} ran", lambda: f"2025-03-{digits(2)} 10:11:12 chunk {digits(12)} done",
    ]
    texts = []
    for _ in range(n):
        text, gold = "", set()
        for _ in range(rng.randint(1, 3)):
            if rng.random() < 0.4:
                text += rng.choice(negative)()
            else:
                for piece in re.split(r"(\{\w+\})", rng.choice(positive).replace("{{", "\x01")):
                    if piece.startswith("{") and piece[1:-1] in makers:
                        value = makers[piece[1:-1]]()
                        gold.add((len(text), len(text) + len(value), piece[1:-1]))
                        text += value
                    else:
                        text += piece.replace("\x01", "{")
            text += rng.choice([" ", "\n"])
        texts.append((text, gold))
    return texts, {fold(g) for g in given}, {fold(f) for f in family}


@lru_cache(maxsize=1)
def fitted(epochs: int = 30, rate: float = 0.5, decay: float = 0.002) -> dict[str, float]:
    """Weights of the field, fitted with adaptive steps; the same on every call."""
    texts, given, family = training_texts()
    data = [(candidates(t, given, family), gold) for t, gold in texts]
    weights: dict[str, float] = {}
    seen: dict[str, float] = {}
    for _ in range(epochs):
        for k in range(0, len(data), 20):
            grad: dict[str, float] = {}
            for spans, gold in data[k : k + 20]:
                gradient(spans, gold, weights, grad)
            for f, g in grad.items():
                g -= decay * weights.get(f, 0.0)
                seen[f] = seen.get(f, 0.0) + g * g
                weights[f] = weights.get(f, 0.0) + rate * g / math.sqrt(seen[f] + 1e-6)
    _folded.clear()
    return weights


# --- on tables --------------------------------------------------------------------------
def lexicon(names: DataFrame, given: str = "given_name", family: str = "family_name") -> tuple[set[str], set[str]]:
    rows = names.select(given, family).distinct().limit(MAX_LEXICON + 1).collect()
    if len(rows) > MAX_LEXICON:
        raise ValueError(f"the name lexicon has more than {MAX_LEXICON} rows")
    return {fold(r[0].strip()) for r in rows if r[0]}, {fold(r[1].strip()) for r in rows if r[1]}


def find_mentions(documents: DataFrame, names: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pii_type, pii_text, start, end) of every mention."""
    given, family = lexicon(names)
    weights = fitted()
    shared = documents.sparkSession.sparkContext.broadcast((given, family, weights))

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, f, w = shared.value
        for frame in frames:
            rows = [
                (i, kind, t[s:e], s, e)
                for i, t in zip(frame["doc_id"].tolist(), frame["text"].tolist())
                if t
                for s, e, kind in decode(candidates(t, g, f), w)
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "pii_type", "pii_text", "start", "end"])

    picked = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    return picked.mapInPandas(scan, "doc_id long, pii_type string, pii_text string, start long, end long")


def redact(documents: DataFrame, names: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, n_mentions) with every mention replaced by a placeholder of its type."""
    given, family = lexicon(names)
    shared = documents.sparkSession.sparkContext.broadcast((given, family, fitted()))

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, f, w = shared.value
        for frame in frames:
            texts, counts = [], []
            for t in frame["text"].tolist():
                found = decode(candidates(t, g, f), w) if t else []
                for s, e, kind in reversed(found):
                    t = f"{t[:s]}[{kind.upper()}]{t[e:]}"
                texts.append(t)
                counts.append(len(found))
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "text": texts, "n_mentions": counts})

    picked = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return picked.mapInPandas(scan, "doc_id long, text string, n_mentions int")
