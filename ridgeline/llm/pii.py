"""Personal data: fixed patterns, and a semi-Markov conditional random field.

The patterns give the base spans.  The field then reads the neighbourhoods of
digits and ``@`` and adds what the patterns' fixed shapes miss: local phone
numbers behind a word like *tel*, obfuscated addresses, addresses of version 6,
account and insurance numbers, keys, passwords and tokens.  It scores whole
candidate spans (their shape, digit groups, checksum, mix of letters and digits,
the words before them), and a dynamic program over segments of at most
``LONGEST`` tokens, however long these are, chooses boundaries and types
together.  It is trained here, by conditional likelihood, on sentences from a
small generator.
"""

from __future__ import annotations

import math
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

KINDS = ("email", "ip", "card", "phone", "secret", "account")
BASE_KINDS = KINDS[:4]
LONGEST = 15  # tokens of an entity; eight groups and seven colons make an address of version 6
BEFORE = 4  # tokens before a span that its features look at
LONGEST_CUE = 40  # letters; a longer word is no cue

LOCAL_PART = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
# A digit run that fails from its start fails from within, so starting inside one is ruled out.
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from each ``@`` backwards: linear however long a run is."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL_PART.match(text, start - 1):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            done = m.end()
            out.append((start, done))
            at = text.find("@", done)
        else:
            done = at + 1  # nothing that starts before this sign can reach beyond it
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind."""
    out = [(a, z, "email") for a, z in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.groups()):
            out.append((*m.span(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = NOT_DIGIT.sub("", m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((*m.span(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


# ---- the field ----

TOKEN = re.compile(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]")
SIGN = re.compile(r"[0-9@]")
BLANK = re.compile(r"\s")
WORDED = re.compile(r"(?<=\s)(?:at|AT)\s++\S++\s++(?:dot|DOT)\s++\S++")
CUES = {
    "phone": ("tel", "phone", "telephone", "mobile", "fax", "call", "telefon", "téléphone", "teléfono", "whatsapp"),
    "email": ("mail", "email", "contact", "correo", "courriel"),
    "card": ("card", "visa", "mastercard", "tarjeta", "carte", "karte"),
    "ip": ("ip", "host", "server", "address", "ipv6"),
    "secret": ("token", "key", "secret", "password", "passwd", "pwd", "passwort", "contraseña", "apikey", "api_key", "bearer", "auth"),
    "account": ("ssn", "iban", "account", "konto", "cuenta", "compte", "passport", "insurance", "social", "security"),
}
CUE_OF = {w: k for k, ws in CUES.items() for w in ws}


class Zone:
    """A stretch of text, its tokens, and running counts over them, so that a span's features cost the same at any length."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.tokens = [m.span() for m in TOKEN.finditer(text)]
        self.words = [text[a:z] for a, z in self.tokens]
        counts = (self.digits, self.letters, self.upper, self.signs, self.ats, self.dots, self.gaps, self.others) = [[0] for _ in range(8)]
        self.shapes, self.groups = [], []
        for k, ((a, z), w) in enumerate(zip(self.tokens, self.words, strict=True)):
            gap = k > 0 and self.tokens[k - 1][1] < a
            d = len(DIGITS.findall(w)) if len(w) > 1 else w.isdigit()
            letters = len(w) - d if w.isascii() and w.isalnum() else int(w.isalpha())
            upper = sum(map(str.isupper, w)) if letters else 0
            worded = w in ("at", "AT") and gap and z < len(text) and text[z].isspace()
            now = (d, letters, upper, (d > 0) | (w == "@") | worded, (w == "@") | worded, w == ".", gap, not w.isalnum())
            for c, v in zip(counts, now, strict=True):
                c.append(c[-1] + v)
            self.shapes.append(shape(w))
            self.groups.append("" if not d else str(len(w)) if d == len(w) else "m")


DIGITS = re.compile(r"\d")
HEX = re.compile(r"[0-9a-fA-F]+\Z")
RUNS = re.compile(r"(\d+)|([^\W\d_a-z]+)|([^\W\d_A-Z]+)")


def shape(s: str) -> str:
    """Kinds of characters, of a run one letter; twelve at most."""
    out = []
    for c in s if len(s) < 64 else RUNS.sub(lambda m: "0" if m[1] else "A" if m[2] else "a", s):
        k = "d" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else "s" if c.isspace() else c
        if not out or out[-1] != k:
            out.append(k)
            if len(out) == 12:
                break
    return "".join(out)


def features(zone: Zone, i: int, j: int) -> list[str]:
    """Of the whole span of tokens i to j - 1, for an entity; the kind is joined to each."""
    text, tokens, words = zone.text, zone.tokens, zone.words
    a, z = tokens[i][0], tokens[j - 1][1]
    size = z - a
    digits, letters, upper = (c[j] - c[i] for c in (zone.digits, zone.letters, zone.upper))
    spaces = zone.gaps[j] - zone.gaps[i + 1]
    solid = not spaces and size == digits + letters
    cue = next((CUE_OF[w] for w in map(str.lower, reversed(words[max(0, i - BEFORE) : i])) if w in CUE_OF), "none")
    left = text[a - 1] if a else " "
    right = text[z] if z < len(text) else " "
    glued = ("L" if left.isalnum() else "") + ("R" if right.isalnum() else "")
    f = [
        "bias", f"cue={cue}", f"digits={min(digits, 20)}", f"n={min(j - i, 6)}", f"glued={glued}",
        f"ends={words[i][0].isalnum():d}{words[j - 1][-1].isalnum():d}", f"left={left if left in '+(=@.-:' else '_'}",
        f"at={zone.ats[j] > zone.ats[i]:d}", f"dots={min(zone.dots[j] - zone.dots[i], 4)}", f"space={spaces > 0:d}",
    ]
    if j - i > 4 and zone.ats[j] > zone.ats[i]:
        f.append(f"worded={words[i + 1].lower() == 'at':d}{words[j - 2].lower() == 'dot':d}")
    groups = [g for g in zone.groups[i:j] if g]
    if 1 < len(groups) < 9:
        f.append(f"groups={'-'.join(groups)}")
    if solid:
        mixed = digits >= 3 and letters >= 3
        f.append(f"solid{'mixed' if mixed else 'digits' if digits == size else 'letters' if not digits else 'few'}={min(size // 4, 8)}")
        if cue != "none" and not mixed and digits and letters:
            f.append(f"cued={cue}")
        if mixed and (upper == letters or not upper or HEX.match(text, a, z)):
            f.append(f"code{size >= 16:d}")
        if text[a : a + 4] in ("AKIA", "ASIA"):
            f.append(f"prefix{size}")
        if digits == size and 14 <= digits <= 19:
            f.append(f"luhn={luhn(text[a:z]):d}")
    else:
        parts = []
        for k in range(i, j):
            if k > i and tokens[k - 1][1] < tokens[k][0]:
                parts.append("s")
            parts.append(zone.shapes[k])
            if len(parts) > 24:
                break
        f.append(f"shape={shape_of(''.join(parts))}")
        if size <= 15 and zone.dots[j] - zone.dots[i] == 3:
            quad = text[a:z].split(".")
            if all(p.isdigit() and len(p) < 4 and int(p) < 256 for p in quad):
                f.append("quad")
        if size <= 39 and (colons := words[i:j].count(":")) >= 2 and not spaces:
            f.append(f"colons={colons}{HEX.match(text[a:z].replace(':', '')) is not None:d}")
    return f


def candidates(zone: Zone, i: int) -> list[int]:
    """Where an entity that starts at token i can end: it holds a digit, ``@`` or *at*, starts with an ASCII letter
    or digit, ``+`` or ``(``, and ends with one, ``)``, ``!``, ``?`` or ``#``."""
    w, signs, words = zone.words[i][0], zone.signs, zone.words
    if not (_plain(w) or w in "+("):
        return []
    last = min(len(words), i + LONGEST)
    if signs[last] == signs[i]:
        return []
    return [j for j in range(i + 1, last + 1) if signs[j] > signs[i] and ((c := words[j - 1][-1]) in ")!?#" or _plain(c))]


def shape_of(kinds: str) -> str:
    """Shapes put together: equal neighbours become one."""
    return "".join([c for k, c in enumerate(kinds) if not k or kinds[k - 1] != c])[:12]


def zones(text: str) -> list[tuple[int, int]]:
    """Neighbourhoods of digits and ``@``: (start, end), apart and in order.

    From a sign, a zone reaches to the white space on either side, or as many
    tokens as an entity and its features can have; words with signs that one or
    two blanks part are together; three words on the left and a character on
    the right come along.  Every character is passed over a bounded number of times.
    """
    seeds = []
    for m in WORDED.finditer(text) if "dot" in text or "DOT" in text else ():
        a = m.start() - 1
        while a and text[a - 1].isspace():
            a -= 1
        seeds.append((_left(text, a, 0), m.end()))
    out: list[list[int]] = []
    k, at, z = 0, SIGN.search(text), 0
    while at or k < len(seeds):
        if at and (k == len(seeds) or at.start() < seeds[k][1]):
            a, end = _left(text, at.start(), z), _right(text, at.end())
            if k < len(seeds) and seeds[k][0] < end:
                a, end, k = min(a, seeds[k][0]), max(end, seeds[k][1]), k + 1
        else:
            a, end = seeds[k]
            k += 1
        if out and a - z <= 2:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([a, end])
        z = max(z, end)
        at = SIGN.search(text, z)
    done = 0
    for zone in out:
        zone[0] = max(done, _context(text, zone[0], done))
        done = zone[1]
        zone[1] = min(len(text), zone[1] + 1)
    together: list[list[int]] = []
    for a, z in out:
        if together and a <= together[-1][1]:
            together[-1][1] = max(z, together[-1][1])
        else:
            together.append([a, z])
    return [(a, z) for a, z in together]


def _plain(c: str) -> bool:
    return c.isascii() and c.isalnum()


def _left(text: str, at: int, least: int) -> int:
    """To the left over what isn't white space, at most as many tokens as matter."""
    n, inside = 0, True
    while at > least and not (c := text[at - 1]).isspace():
        if not (inside and _plain(c)):
            n += 1
            if n > LONGEST + BEFORE:
                break
        inside = _plain(c)
        at -= 1
    return at


def _right(text: str, at: int) -> int:
    n, inside, most = 0, True, len(text)
    while at < most and not (c := text[at]).isspace():
        if not (inside and _plain(c)):
            n += 1
            if n > LONGEST:
                break
        inside = _plain(c)
        at += 1
    return at


def _context(text: str, at: int, least: int) -> int:
    """The start of the third word to the left; a word too long to be a cue ends the way."""
    for _ in range(3):
        z = at
        while z > least and text[z - 1].isspace():
            z -= 1
        a = z
        while a > least and not text[a - 1].isspace():
            a -= 1
            if z - a > LONGEST_CUE:
                return at
        if a == z:
            return at
        at = a
    return at


class SemiMarkovField:
    """Weights of a feature for each kind; a span's score for a kind is the sum over its features."""

    def __init__(self, weights: dict[str, list[float]] | None = None) -> None:
        self.w = {} if weights is None else weights

    def best(self, zone: Zone) -> list[tuple[int, int, str]]:
        """The best segmentation: every other token is a segment of its own and scores 0."""
        n, tokens, get, kinds = len(zone.tokens), zone.tokens, self.w.get, range(len(KINDS))
        value, back = [0.0] + [-math.inf] * n, [(0, "")] * (n + 1)
        for i in range(n):  # a start's features go before the next one's come, so a long zone takes little memory
            v = value[i]
            if v > value[i + 1]:
                value[i + 1], back[i + 1] = v, (i, "")
            for j in candidates(zone, i):
                rows = [w for w in map(get, features(zone, i, j)) if w]
                for k in kinds:
                    s = v + sum([w[k] for w in rows])
                    if s > value[j] and s > v:
                        value[j], back[j] = s, (i, KINDS[k])
        out, j = [], n
        while j:
            i, k = back[j]
            if k:
                out.append((tokens[i][0], tokens[j - 1][1], k))
            j = i
        return out[::-1]

    def fit(self, sentences, epochs: int = 6, rate: float = 0.25, decay: float = 1e-4) -> None:
        """Ascent on the conditional likelihood with adaptive steps."""
        names: dict[str, int] = {}
        ready = [Lattice(text, gold, names) for text, gold in sentences]
        w = np.zeros((len(names), len(KINDS)))
        squares = np.full_like(w, 1e-9)
        for _ in range(epochs):
            for s in ready:
                if len(s.spans):
                    rows, g = s.gradient(w)[1:]
                    g -= decay * w[rows]
                    squares[rows] += g * g
                    w[rows] += rate * g / (np.sqrt(squares[rows]) + 1e-6)
        w = np.where(np.abs(w) > 1e-3, w.round(4), 0)
        self.w = {x: w[k].tolist() for x, k in names.items() if w[k].any()}


class Lattice:
    """A sentence's candidate spans, as arrays, with what is right among them."""

    def __init__(self, text: str, gold: list[tuple[int, int, str]], names: dict[str, int]) -> None:
        zone = Zone(text)
        self.n = len(zone.tokens)
        self.spans, index, starts, right = [], [], [], []
        where = {(a, z): KINDS.index(k) for a, z, k in gold}
        for i in range(self.n):
            for j in candidates(zone, i):
                starts.append(len(index))
                index += [names.setdefault(x, len(names)) for x in features(zone, i, j)]
                self.spans.append((i, j))
                k = where.get((zone.tokens[i][0], zone.tokens[j - 1][1]))
                right.append([float(k == c) for c in range(len(KINDS))])
        self.starts = np.array(starts, np.int64)
        self.rows, self.of = np.unique(np.array(index, np.int64), return_inverse=True)
        self.index, self.right = np.array(index, np.int64), np.array(right).reshape(-1, len(KINDS))
        self.lengths = np.diff(np.concatenate([self.starts, [len(index)]]))

    def gradient(self, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood of the right segmentation, the rows of ``w`` it depends on, and their gradient
        (forward-backward over segments; tokens apart score 0)."""
        scores = np.add.reduceat(w[self.index], self.starts)
        most = scores.max(1)
        any_kind = (most + np.log(np.exp(scores - most[:, None]).sum(1))).tolist()
        add = lambda x, y: max(x, y) + math.log1p(math.exp(-abs(x - y))) if min(x, y) > -math.inf else max(x, y)
        forward, behind, at = [0.0] + [-math.inf] * self.n, [-math.inf] * self.n + [0.0], 0
        for i in range(self.n):
            forward[i + 1] = add(forward[i + 1], forward[i])
            while at < len(self.spans) and self.spans[at][0] == i:
                j = self.spans[at][1]
                forward[j] = add(forward[j], forward[i] + any_kind[at])
                at += 1
        for i in range(self.n - 1, -1, -1):
            behind[i] = add(behind[i], behind[i + 1])
            while at and self.spans[at - 1][0] == i:
                at -= 1
                behind[i] = add(behind[i], any_kind[at] + behind[self.spans[at][1]])
        outside = np.array([forward[i] + behind[j] for i, j in self.spans]) - forward[self.n]
        short = self.right - np.exp(scores + outside[:, None])
        g = np.zeros((len(self.rows), len(KINDS)))
        np.add.at(g, self.of, np.repeat(short, self.lengths, axis=0))
        return float((scores * self.right).sum() - forward[self.n]), self.rows, g


def examples(n: int = 1500, seed: int = 7) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Generated sentences with their entities, and sentences whose numbers are none."""
    r = random.Random(seed)
    hexa, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    word = lambda: "".join(r.choice(("th", "er", "on", "an", "re", "in", "ed", "la", "que", "sch", "ment")) for _ in range(r.randint(1, 4)))
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card() -> str:
        d = r.choice(("4", "5", "37")) + digits(13)
        d = d[:15]
        d += next(x for x in "0123456789" if luhn(d + x))
        return d if r.random() < 0.6 else r.choice(" -").join(d[k : k + 4] for k in range(0, 16, 4))

    def local_phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{digits(3)} {digits(6)}", f"+{r.randint(1, 99)} ({a}) {b}-{c}"))

    def mail() -> str:
        u, h = word() + r.choice(("", "." + word(), digits(2))), word()
        return r.choice((f"{u}@{h}.example.com", f"{u}@{h}.org", f"{u} at {h} dot com", f"{u} at {h} dot com"))

    hexes = lambda k: "".join(r.choice(hexa) for _ in range(k))
    code = lambda k: "".join(r.choice(alnum) for _ in range(k))

    def address() -> str:
        if r.random() < 0.4:
            return ".".join(str(r.randint(0, 255)) for _ in range(4))
        groups = [hexes(r.randint(1, 4)) for _ in range(r.choice((3, 4, 5, 8, 8)))]
        return ":".join(groups) if len(groups) == 8 else ":".join(groups[: (k := r.randint(1, len(groups) - 1))]) + "::" + ":".join(groups[k:])

    def secret() -> str:
        return r.choice((hexes(r.choice((32, 40, 64))), "AKIA" + code(16), "".join(r.choice((c, c.lower())) for c in code(r.choice((24, 40))))))

    def password() -> str:
        w = word()
        return r.choice((w + digits(r.randint(1, 4)), w.capitalize() + digits(2) + r.choice("!?#"), w + digits(1) + word()))

    def account() -> str:
        if r.random() < 0.5:
            return f"{digits(3)}-{digits(2)}-{digits(4)}"
        iban = r.choice(("DE", "FR", "GB", "ES", "NL")) + digits(2) + r.choice(("", code(4))) + digits(r.choice((14, 18)))
        return iban if r.random() < 0.5 else " ".join(iban[k : k + 4] for k in range(0, len(iban), 4))

    makers = (
        ("email", mail, ("mail", "contact", "email", "", "", "")), ("ip", address, ("host", "ip", "server", "")), ("card", card, ("card", "visa", "")),
        ("phone", local_phone, ("tel", "phone", "call", "mobile", "tel:")), ("secret", secret, ("token =", "key:", "secret =", "", "")),
        ("secret", password, ("password:", "passwd =", "pwd:", "password")), ("account", account, ("ssn", "iban", "account", "ssn:", "IBAN")),
    )
    plain = [
        lambda: str(r.randint(1, 99999)), lambda: str(r.randint(1900, 2030)), lambda: f"{r.randint(1, 12)}.{r.randint(0, 99)}",
        lambda: f"{r.randint(1, 28)}/{r.randint(1, 12)}/{r.randint(1990, 2025)}", lambda: f"{r.randint(1, 9)}.{r.randint(0, 9)}.{r.randint(0, 9)}",
        lambda: f"{r.randint(1, 999)},{digits(3)}", lambda: f"{r.randint(0, 23)}:{digits(2)}", lambda: word() + str(r.randint(1, 99)),
        lambda: digits(r.randint(6, 13)), lambda: "@" + word(), lambda: f"{r.randint(1, 20)}-{r.randint(21, 90)}", lambda: f"{digits(4)}-{digits(2)}-{digits(2)}",
        lambda: "http://" + word() + ".example.com/" + digits(3), lambda: f"{digits(2)}:{digits(2)}:{digits(2)}", lambda: f"{word()}_{digits(2)}({word()})",
        lambda: f"{digits(1)}, {digits(2)}, {digits(2)}, {digits(3)}", lambda: f"{digits(3)} {digits(2)} {digits(4)}", lambda: f"{word()}-{digits(3)}-{word()}",
        lambda: f"{digits(2)}-{digits(2)}-{digits(4)}", lambda: f"v{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}.{r.randint(300, 2000)}",
        lambda: r.choice(("key", "account", "call", "card", "address", "host", "security")) + " " + str(r.randint(1, 999)),
    ]
    out = []
    for _ in range(n):
        parts, gold, at = [], [], 0

        def put(s: str, kind: str = "") -> None:
            nonlocal at
            if parts:
                parts.append(" ")
                at += 1
            if kind:
                gold.append((at, at + len(s), kind))
            parts.append(s)
            at += len(s)

        for _ in range(r.randint(1, 3)):
            put(word())
        if r.random() < 0.55:
            kind, make, cues = r.choice(makers)
            cue = r.choice(cues)
            if cue:
                put(cue)
            quoted = kind == "secret" and r.random() < 0.5
            s = make()
            if quoted:
                put('"' + s + '"')
                gold.append((at - len(s) - 1, at - 1, kind))
            else:
                put(s, kind)
        else:
            for _ in range(r.randint(1, 2)):
                put(r.choice(plain)())
                put(word())
        put(word())
        out.append(("".join(parts), gold))
    return out


@lru_cache(maxsize=1)
def trained() -> dict[str, list[float]]:
    """The field's weights: a few thousand numbers, the same in every run."""
    field = SemiMarkovField()
    field.fit(examples())
    return field.w


def added_spans(text: str, field: SemiMarkovField, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Entities the field finds that touch no base span."""
    out, k = [], 0
    for a, z in zones(text):
        for x, y, kind in field.best(Zone(text[a:z])):
            x, y = x + a, y + a
            while k < len(base) and base[k][1] <= x:
                k += 1
            near = k
            while near < len(base) and base[near][0] < y:
                if base[near][1] > x:
                    break
                near += 1
            else:
                out.append((x, y, kind))
    return out


def spell(spans) -> str:
    return ",".join([f"{k}:{a}:{z}" for a, z, k in spans])


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``(<id_col>, base, spans, redacted)`` and the columns named in ``carry``, a row for a row.

    ``base`` and ``spans`` are ``array<struct<start,end,kind>>`` in code points, by
    start and kind: the patterns' spans, and those with what the field adds.
    ``redacted`` is the text with every span replaced by its kind in brackets
    (where spans overlap, by the first one's).  A null text has no spans and stays
    null; ids may be null or repeated; an empty table gives an empty result;
    other columns are ignored.
    """
    weights = trained()
    fields = [docs.schema[c] for c in (id_col, *carry)]
    spans = "array<struct<start:long,end:long,kind:string>>"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches):
        field = SemiMarkovField(weights)
        for b in batches:
            base, every, red = [], [], []
            for t in b.column(0).to_pylist():
                found = base_spans(t or "")
                more = added_spans(t, field, found) if t else []
                full = sorted([*found, *more], key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
                at, parts = 0, []
                for a, z, k in full if t else ():
                    if a >= at:
                        parts += [t[at:a], f"[{k.upper()}]"]
                    at = max(at, z)
                red.append(None if t is None else "".join([*parts, t[at:]]))
                base.append([{"start": a, "end": z, "kind": k} for a, z, k in found])
                every.append([{"start": a, "end": z, "kind": k} for a, z, k in full])
            yield pa.RecordBatch.from_arrays(
                [*b.columns[1:], pa.array(base, kind), pa.array(every, kind), pa.array(red, pa.string())],
                [*[f"_k{i}" for i in range(len(fields))], "base", "spans", "redacted"],
            )

    spec = ", ".join(f"_k{i} {f.dataType.simpleString()}" for i, f in enumerate(fields))
    got = docs.select(F.col(text_col).cast("string").alias("_t"), *[F.col(f.name).alias(f"_k{i}") for i, f in enumerate(fields)])
    got = got.mapInArrow(tidy(run), f"{spec}, base {spans}, spans {spans}, redacted string")
    return got.select(*[F.col(f"_k{i}").alias(f.name) for i, f in enumerate(fields)], "base", "spans", "redacted")
