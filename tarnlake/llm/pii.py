"""Personal data: exact patterns, and candidates that boosted trees accept or refuse."""

from __future__ import annotations

import bisect
import ipaddress
import math
import re
import string
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import trees
from ._shared import map_batches

#: Kinds that the exact patterns find, in the order in which they are listed.
BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds that only the model finds.
MODEL_KINDS = ("email_spelt", "phone_local", "iban", "ssn", "secret", "ipv6", "passport")
#: Precision on held-out examples that the threshold of each kind must reach.
PRECISION = 0.98

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by the exact patterns: leftmost non-overlapping matches of each kind, those that fail its test dropped."""
    out: list[tuple[str, int, int]] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        for m in _PHONE.finditer(text) if "+" in text else ():
            if 8 <= sum(c in string.digits for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


#: Generators of candidates: more than is wanted, and overlapping.
_CANDIDATES = {
    "email_spelt": re.compile(r"(?<![\w.])[A-Za-z0-9._-]{1,64} ?[(\[{<]?\b(?:at|AT)\b[)\]}>]? ?[A-Za-z0-9-]{1,63}(?: ?[(\[{<]?\b(?:dot|DOT)\b[)\]}>]? ?[A-Za-z0-9-]{1,63}){1,3}"),
    "phone_local": re.compile(r"(?<![\w+])\(?[0-9]{2,4}\)?[ ./-]{1,2}[0-9]{3,4}[ ./-][0-9]{3,4}(?!\w)"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{2,4}){3,8}(?!\w)"),
    "ssn": re.compile(r"(?<![\w-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![\w-])"),
    "secret": re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}+"),
    "ipv6": re.compile(r"(?<![\w:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:.])"),
    "passport": re.compile(r"(?<![\w-])[A-Z]{1,2}[0-9]{6,8}(?![\w-])"),
}
_HINT = {"email_spelt": re.compile(r"[aA][tT]"), "phone_local": _DIGIT, "iban": _DIGIT, "ssn": _DIGIT, "secret": None, "ipv6": re.compile("[0-9A-Fa-f]:[0-9A-Fa-f:]"), "passport": _DIGIT}
_CONTEXT = {
    "email_spelt": re.compile(r"(?i)mail|contact|write|reach"),
    "phone_local": re.compile(r"(?i)\b(?:tel|phone|call|mobile|fax|cell)"),
    "iban": re.compile(r"(?i)\b(?:iban|bank|account|konto|transfer)"),
    "ssn": re.compile(r"(?i)\b(?:ssn|social|security|tax)"),
    "secret": re.compile(r"(?i)(?:token|key|secret|passw|auth|bearer|credential)"),
    "ipv6": re.compile(r"(?i)\b(?:ip|ipv6|host|address|server|client|from|login)\b"),
    "passport": re.compile(r"(?i)\b(?:passport|travel document|reisepass|pasaporte)\b"),
}
_TOP_DOMAINS = frozenset(("com", "org", "net", "edu", "gov", "de", "fr", "es", "it", "uk", "io", "eu", "info"))
_AGAINST = re.compile(r"(?i)\b(?:version|build|order|isbn|invoice|page|chapter|figure|price|total|sha\d*|commit|md5)\b")


def _mod97(text: str) -> bool:
    s = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _is_ipv6(text: str) -> bool:
    try:
        return bool(ipaddress.IPv6Address(text))
    except ValueError:
        return False


def features(kind: str, text: str, start: int, end: int) -> list[float]:
    """Format of a candidate and words around it."""
    span = text[start:end]
    n = len(span)
    before, after = text[max(0, start - 40) : start], text[end : end + 20]
    seen: dict[str, int] = {}
    for c in span:
        seen[c] = seen.get(c, 0) + 1
    digits = sum(v for c, v in seen.items() if c in string.digits)
    lower, upper = sum(v for c, v in seen.items() if c.islower()), sum(v for c, v in seen.items() if c.isupper())
    changes = sum((a in string.digits) != (b in string.digits) for a, b in zip(span, span[1:], strict=False))
    return [
        *(float(kind == k) for k in MODEL_KINDS), n, digits / n, lower / n, upper / n, -sum(v / n * math.log2(v / n) for v in seen.values()), changes / n,
        float(all(c in string.hexdigits for c in span)), float(len(seen)), float(bool(_CONTEXT[kind].search(before))), float(bool(_AGAINST.search(before))),
        float(before[-1:] in "\"'=:") if before else 0.0, float(after[:1] in "\"'") if after else 0.0, float(kind == "iban" and _mod97(span)), float("(" in span or "[" in span), float(span.rpartition(" ")[2].lower() in _TOP_DOMAINS),
        float(kind == "ipv6" and _is_ipv6(span)),
    ]


def candidates(text: str) -> list[tuple[str, int, int]]:
    """What the generators propose in a text; spans of several kinds may overlap."""
    return [(kind, *m.span()) for kind, rx in _CANDIDATES.items() if not _HINT[kind] or _HINT[kind].search(text) for m in rx.finditer(text)]


def _examples(rng: np.random.Generator, n: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Written examples of each kind, and look-alikes that are not personal data, each in a sentence."""
    pick = lambda xs: xs[rng.integers(len(xs))]
    digits = lambda k: "".join(str(x) for x in rng.integers(0, 10, k))
    word = lambda lo=3, hi=10: "".join(pick(string.ascii_lowercase) for _ in range(rng.integers(lo, hi)))
    mixed = lambda k, letters: "".join(pick(letters) for _ in range(k))

    def iban(valid: bool) -> str:
        body = mixed(rng.integers(14, 23), string.digits + (string.ascii_uppercase if rng.random() < 0.3 else ""))
        land = pick(["DE", "FR", "ES", "IT", "GB", "NL"])
        check = 98 - int("".join(str(int(c, 36)) for c in f"{body}{land}00")) % 97
        s = f"{land}{check if valid else (check + rng.integers(1, 90)) % 97:02d}{body}"
        return " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if rng.random() < 0.5 else s

    good = {
        "email_spelt": lambda: f"{word()}{pick(['', '.' + word(), digits(2)])} {pick(['at', '(at)', '[at]', 'AT'])} {word()} {pick(['dot', '(dot)', '[dot]', 'DOT'])} {pick(['com', 'org', 'net', 'de', 'fr', 'es', 'io'])}",
        "phone_local": lambda: pick([lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", lambda: f"{digits(3)}.{digits(3)}.{digits(4)}"])(),
        "iban": lambda: iban(True),
        "ssn": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        "secret": lambda: pick([lambda: mixed(rng.integers(32, 65), "0123456789abcdef"), lambda: mixed(rng.integers(24, 48), string.ascii_letters + string.digits), lambda: "sk-" + mixed(32, string.ascii_letters + string.digits), lambda: "AKIA" + mixed(16, string.ascii_uppercase + string.digits), lambda: mixed(rng.integers(100, 600), string.ascii_letters + string.digits + "+/"), lambda: mixed(rng.integers(28, 48), string.ascii_letters)])(),
        "ipv6": lambda: pick([lambda: ":".join(mixed(rng.integers(1, 5), "0123456789abcdef") for _ in range(8)), lambda: "2001:db8::" + mixed(rng.integers(1, 5), "0123456789abcdef"), lambda: "fe80::" + ":".join(mixed(4, "0123456789abcdef") for _ in range(4))])(),
        "passport": lambda: mixed(rng.integers(1, 3), string.ascii_uppercase) + digits(rng.integers(6, 9)),
    }
    bad = {
        "email_spelt": lambda: f"{word()} at {word()} dot {word()}",
        "phone_local": lambda: pick([lambda: f"{digits(2)}/{digits(4)}/{digits(3)}", lambda: f"{digits(4)} {digits(4)} {digits(4)}", lambda: f"{digits(3)} {digits(3)} {digits(3)}", lambda: f"{digits(4)}-{digits(4)}-{digits(3)}"])(),
        "iban": lambda: iban(False),
        "ssn": lambda: pick([lambda: f"{digits(3)} {digits(2)} {digits(4)}", lambda: f"{digits(3)}-{digits(2)}-{digits(4)}"])(),
        "secret": lambda: pick([lambda: word(20, 40), lambda: f"{word()}-{word()}-{word()}-{word()}", lambda: f"{word()}/{word()}/{word()}/{digits(4)}", lambda: f"{word()}_{word()}_{word()}_{digits(2)}", lambda: digits(rng.integers(20, 40)), lambda: "=" * int(rng.integers(20, 40)) + digits(1), lambda: word(12, 20) + digits(8) + word(3, 9), lambda: pick("-=_/") * int(rng.integers(20, 400)), lambda: word(2, 4) * int(rng.integers(10, 100)), lambda: "/".join(word() for _ in range(rng.integers(4, 40))), lambda: "".join(word(3, 8).title() for _ in range(rng.integers(4, 9)))])(),
        "ipv6": lambda: pick([lambda: f"{digits(2)}:{digits(2)}:{digits(2)}", lambda: ":".join(mixed(2, "0123456789abcdef") for _ in range(6)), lambda: f"{digits(1)}:{digits(2)}:{digits(2)}:{digits(2)}", lambda: "::" + digits(1) * 0 + ":"])(),
        "passport": lambda: mixed(rng.integers(1, 3), string.ascii_uppercase) + digits(rng.integers(6, 9)),
    }
    cues = {
        "email_spelt": ["mail me: ", "contact ", "write to ", "reach "], "phone_local": ["phone ", "call ", "tel. ", "mobile: "], "iban": ["IBAN ", "account ", "transfer to "],
        "ssn": ["SSN ", "social security ", "ssn: "], "secret": ['token = "', 'api_key: "', "secret=", 'password = "', "Authorization: Bearer "],
        "ipv6": ["from ", "host ", "IP ", "address "], "passport": ["passport ", "Passport no. ", "travel document "],
    }
    x, y, kinds = [], [], []
    for _ in range(n):
        kind, label = pick(MODEL_KINDS), int(rng.random() < 0.5)
        span = (good if label else bad)[kind]()
        cue = rng.random()
        lead = pick(cues[kind]) if label and (cue < 0.8 or kind in ("ssn", "phone_local", "passport")) else pick(["version ", "order ", "isbn ", "page ", "commit ", "sha256 "]) if not label and cue < 0.4 else ""
        if not label and kind == "secret" and lead in ("commit ", "sha256 ") and cue < 0.3:
            span = mixed(pick([40, 64]), "0123456789abcdef")
        text = f"{word()} {word()} {lead}{span}{pick(['', '.', ' '])}{chr(34) if lead.endswith(chr(34)) else ''} {word()}"
        start = text.index(span)
        x.append(features(kind, text, start, start + len(span)))
        y.append(label)
        kinds.append(kind)
    return np.array(x), np.array(y, dtype=float), kinds


@cache
def model() -> tuple[trees.Forest, dict[str, float]]:
    """The forest and the threshold of each kind: the lowest score at and above which held-out precision is PRECISION."""
    rng = np.random.default_rng(20)
    x, y, _ = _examples(rng, 6000)
    forest = trees.fit(x, y, trees=60, depth=4)
    hx, hy, hk = _examples(rng, 4000)
    p, kinds = forest.probability(hx), np.array(hk)
    cuts = {}
    for kind in MODEL_KINDS:
        mine = kinds == kind
        order = np.argsort(-p[mine], kind="stable")
        score, right = p[mine][order], np.cumsum(hy[mine][order])
        good = np.flatnonzero(right / np.arange(1, len(right) + 1) >= PRECISION)
        cuts[kind] = float(max(0.5, score[good[-1]])) if len(good) else 2.0
    return forest, cuts


def spans_of(text: str, forest: trees.Forest, cuts: dict[str, float]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, spans that the model adds): accepted candidates, best score first, that overlap nothing taken before."""
    base = base_spans(text)
    found = candidates(text)
    if not found:
        return base, []
    p = forest.probability(np.array([features(k, text, a, b) for k, a, b in found]))
    starts: list[int] = []  # of spans that don't overlap, with their ends
    ends: list[int] = []
    for _, a, b in sorted(base, key=lambda s: s[1]):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a), ends.append(b)
    added = []
    for score, (kind, a, b) in sorted(zip(-p, found, strict=True)):
        at = bisect.bisect_left(ends, a + 1)  # the first that ends beyond the candidate's start
        if -score >= cuts[kind] and (at == len(starts) or starts[at] >= b):
            starts.insert(at, a), ends.insert(at, b)
            added.append((kind, a, b))
    return base, added


def listed(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end, comma-joined, by kind as listed and then start."""
    order = {k: i for i, k in enumerate(BASE_KINDS + MODEL_KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (order[s[0]], s[1], s[2])))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """`text` with every span replaced by its kind in brackets; overlapping spans are replaced together, by the first's kind."""
    out, at = [], 0
    merged: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, base spans and added spans (as listed()) of every row of `docs`; null texts count as empty and have none.

    Offsets are code points, the end exclusive. Repeated rows are each searched, null ids pass through, other columns are
    not read, and an empty table gives no rows.
    """
    forest, cuts = model()

    def fn(batch):
        base, every, counts = [], [], {k: [] for k in BASE_KINDS}
        for text in batch.column("text").to_pylist():
            b, added = spans_of(text or "", forest, cuts)
            base.append(listed(b))
            every.append(listed(b + added))
            for k, v in counts.items():
                v.append(sum(s[0] == k for s in b))
        return {"doc_id": batch.column("doc_id"), "base_spans": base, "spans": every} | {f"n_{k}": v for k, v in counts.items()}

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string"
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), fn, schema)


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with every span found replaced by its kind, as [EMAIL]; null texts stay null, other columns are unchanged."""
    forest, cuts = model()

    @F.pandas_udf("string")
    def clean(texts):
        def one(text):
            if text is None:
                return None
            base, added = spans_of(text, forest, cuts)
            return redacted(text, base + added) if base or added else text

        return texts.map(one)

    return docs.withColumn("text", clean("text"))

