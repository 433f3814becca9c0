"""Candidates for secrets, their features, and labelled findings to learn from (no Spark here)."""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter
from dataclasses import dataclass, field

import numpy as np

#: A candidate without a key beside it: this many characters of the set below, one of them a digit.
SHORTEST = 16
_SET = np.zeros(256, np.bool_)
_SET[[ord(c) for c in string.ascii_letters + string.digits + "_+/=-"]] = True
_DIGITS = np.zeros(256, np.bool_)
_DIGITS[48:58] = True
_KEY = r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|credential|api[_-]?key|access[_-]?key|private[_-]?key|auth)"
#: A key's name with what may follow it, an assignment sign, and an opening quotation mark.
_BESIDE = _KEY + r"""[a-z_-]{0,16}["']?\s{0,3}(?::=|=>|=|:)\s{0,3}["'`]?"""
_KEYED = re.compile(_BESIDE + r"""([^\s"'`,;]{6,})""", re.IGNORECASE)
_ASSIGNED = re.compile(_BESIDE + "$", re.IGNORECASE)
_PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----)?")
_PREFIX = re.compile(
    r"(?:AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|sk-|sk_live_|rk_live_"
    r"|xox[abprs]-|AIza|ya29\.|eyJ|SG\.|npm_|-----BEGIN)"
)
_SECRETIVE = re.compile(r"pass|pwd|secret|token|credential|key|auth|bearer|private|login|signin", re.IGNORECASE)
_HARMLESS = re.compile(
    r"sha|commit|md5|checksum|digest|hash|uuid|guid|etag|version|build|revision|example|sample|dummy|test"
    r"|isbn|order|invoice|card|phone|serial|url|http|href|src=|image|cache",
    re.IGNORECASE,
)
_PLACEHOLDER = re.compile(
    r"x{4,}|\*{3,}|\.{3,}|your|example|changeme|change_me|placeholder|dummy|redacted|<|>|\$\{|\{\{"
    r"|insert|todo|none|null|undefined|sample",
    re.IGNORECASE,
)
_HARMLESS_PATH = re.compile(
    r"(?:^|[/_.-])(?:tests?|spec|fixtures?|examples?|docs?|samples?|mocks?|vendor|lock|min)(?:$|[/_.-])",
    re.IGNORECASE,
)
_DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})", re.IGNORECASE)
_UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.IGNORECASE)
_WORD = re.compile(r"[A-Za-z]{4,}")
#: Characters of context on each side.
AROUND = 48
FEATURES = [
    "length", "digits", "upper", "lower", "marks", "entropy", "transitions", "switches",
    "covered", "hex", "only_digits", "uuid", "prefix", "placeholder", "repeats", "quoted",
    "assigned", "secretive", "harmless", "neighbour_words", "path_harmless", "path_depth", "in_path",
]


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans (characters) that might be secrets, in order and without overlaps."""
    found = [m.span(1) for m in _KEYED.finditer(text)]
    if "-----BEGIN" in text:
        found += [m.span() for m in _PEM.finditer(text)]
    data = text.encode("utf-8", "surrogatepass")
    codes = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(_SET[codes], prepend=False, append=False))
    begins, ends = edges[::2], edges[1::2]
    long = ends - begins >= SHORTEST
    begins, ends = begins[long], ends[long]
    if len(begins):
        digits = np.cumsum(np.r_[0, _DIGITS[codes]])
        some = digits[ends] > digits[begins]
        # bytes to characters: continuation bytes don't count
        place = np.cumsum(np.r_[0, (codes & 0xC0) != 0x80])
        found += [(int(a), int(b)) for a, b in zip(place[begins[some]], place[ends[some]], strict=True)]
    out: list[tuple[int, int]] = []
    for a, b in sorted(found, key=lambda x: (x[0], -x[1])):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


@dataclass
class Language:
    """What ordinary words look like: a dictionary, and log probabilities of character transitions within its words."""

    words: frozenset = frozenset()
    steps: dict = field(default_factory=dict)
    floor: float = -8.0

    def likelihood(self, value: str) -> float:
        """Mean log probability of the value's character transitions."""
        low = value.lower()
        return sum(self.steps.get(a + b, self.floor) for a, b in zip(low, low[1:], strict=False)) / max(1, len(low) - 1)

    def coverage(self, value: str) -> float:
        """Share of the characters that lie in dictionary words of four letters or more, longest first from the left."""
        covered = 0
        for run in _WORD.findall(value):
            run, k = run.lower(), 0
            while k < len(run):
                size = next((n for n in range(min(24, len(run) - k), 3, -1) if run[k : k + n] in self.words), 0)
                covered += size
                k += size or 1
        return covered / max(1, len(value))


def features(value: str, before: str, after: str, path: str, language: Language) -> list[float]:
    n = len(value)
    digits = sum(c.isdigit() for c in value)
    upper = sum("A" <= c <= "Z" for c in value)
    lower = sum("a" <= c <= "z" for c in value)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "m" for c in value]
    counts = Counter(value)
    tail = before.rstrip().rstrip("\"'`").rstrip()
    near = f"{before[-AROUND:]} {after[:AROUND]}"
    words = [w.lower() for w in _WORD.findall(near)]
    return [
        min(n, 512),
        digits / n,
        upper / n,
        lower / n,
        1 - (digits + upper + lower) / n,
        -sum(k / n * math.log2(k / n) for k in counts.values()),
        language.likelihood(value),
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        language.coverage(value),
        all(c in "0123456789abcdefABCDEF" for c in value),
        digits == n,
        bool(_UUID.search(value)),
        bool(_PREFIX.match(value)),
        bool(_PLACEHOLDER.search(value)),
        max(counts.values()) / n,
        before[-1:] in ("'", '"', "`") and len(before) > 0,
        tail[-1:] in ("=", ":") and len(tail) > 0,
        len(_SECRETIVE.findall(before[-AROUND:])),
        len(_HARMLESS.findall(near)),
        sum(w in language.words for w in words) / max(1, len(words)),
        bool(_HARMLESS_PATH.search(path)),
        path.count("/"),
        before[-1:] in ("/", ".") or value.count("/") > 2,
    ]


def rows(text: str, spans: list[tuple[int, int]], path: str, language: Language) -> np.ndarray:
    """Features of the spans of a text."""
    return np.array([features(text[a:b], text[max(0, a - AROUND) : a], text[b : b + AROUND], path, language) for a, b in spans], np.float64).reshape(-1, len(FEATURES))


def sure_label(value: str, before: str, after: str) -> int | None:
    """What a candidate is where its surroundings leave no doubt, else None.

    1: a value of 20 characters or more and some variety beside a key. 0: a
    number, a UUID, or a digest that its neighbours call harmless, without a key.
    """
    keyed = bool(_ASSIGNED.search(before))
    if keyed and not _PLACEHOLDER.search(value) and len(value) >= 20 and len(set(value)) >= 10 and not _HARMLESS.search(after[:AROUND]):
        return 1
    plain = not keyed and not _SECRETIVE.search(before[-AROUND:])
    if plain and (value.isdigit() or _UUID.fullmatch(value) or (_DIGEST.fullmatch(value) and _HARMLESS.search(before[-AROUND:]))):
        return 0
    return None


def labelled_findings(words: list[str], n: int = 4000, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """(value, before, after, path, label): findings of the kinds that reviews label, written from patterns.

    Positives are random keys and passwords where code keeps them; negatives
    are what looks like them: digests, ids, numbers, paths, placeholders, words
    joined by marks. The same words stand around both.
    """
    rng = random.Random(seed)
    words = words or ["value", "data", "file", "item"]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    rand = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    hexa, b64, alnum = "0123456789abcdef", string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits
    day = lambda: f"20{rng.randint(10, 29)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}-{rng.randint(1000, 9999)}-{rng.randint(10, 99)}"
    dummies = ["your_token_here", "xxxxxxxxxxxxxxxx1", "changeme123", "<your-api-key-1>", "example-token-0000", "${SECRET_TOKEN_1}", "placeholder_key_1"]
    keys = ["token", "secret", "api_key", "apiKey", "access_key", "password", "passwd", "auth_token", "SECRET_KEY", "client_secret", "private_key"]
    out = []
    for k in range(n):
        path = rng.choice(["src/app/settings.py", "config/prod.yaml", ".env", "deploy/main.tf", "", "web", "tests/test_auth.py", "docs/usage.md"])
        around = (text(rng.randint(0, 6)), text(rng.randint(0, 6)))
        quote = rng.choice(['"', "'", '"', ""])
        sign = rng.choice([" = ", "=", ": ", " := "])
        if k % 2:
            value = rng.choice([
                lambda: rand(hexa, rng.choice([32, 40, 64])),
                lambda: rand(b64, rng.choice([24, 40, 44])) + rng.choice(["", "="]),
                lambda: "AKIA" + rand(string.ascii_uppercase + string.digits, 16),
                lambda: "ghp_" + rand(alnum, 36),
                lambda: "sk-" + rand(alnum, 40),
                lambda: rand(alnum, rng.randint(16, 40)),
                lambda: "eyJ" + rand(alnum + "_-", 60),
                lambda: rng.choice(words).capitalize() + rand(string.digits + "!#%", 4) + rand(alnum, 4),
                lambda: "xoxb-" + rand(string.digits, 12) + "-" + rand(alnum, 24),
            ])()
            known = bool(_PREFIX.match(value))
            before = f"{around[0]} {rng.choice(keys)}{sign}{quote}" if not known or rng.random() < 0.7 else f"{around[0]} {quote}"
            out.append((value, before, f"{quote} {around[1]}", path, 1))
        else:
            value, before = rng.choice([
                lambda: (rand(hexa, 40), rng.choice(["commit ", "sha1: ", "revision ", "sha: "])),
                lambda: (rand(hexa, rng.choice([32, 64])), rng.choice(["md5 ", "sha256: ", "checksum = ", "etag: ", "digest "])),
                lambda: ("-".join(rand(hexa, m) for m in (8, 4, 4, 4, 12)), rng.choice(["id ", "uuid = ", "request ", ""])),
                lambda: (rand(string.digits, rng.choice([16, 16, 17, 20])), rng.choice(["card ", "order ", "", "", ""])),
                lambda: ("/".join(rng.choice(words) for _ in range(4)) + f"/{rng.randint(1, 99)}", rng.choice(["http://", "/", ""])),
                lambda: ("_".join(rng.choice(words) for _ in range(3)) + f"_{rng.randint(1, 9)}", ""),
                lambda: ("".join(rng.choice(words) for _ in range(4)) + str(rng.randint(1, 2050)), ""),
                lambda: (rng.choice(dummies), f"{rng.choice(keys)}{sign}"),
                lambda: (day(), rng.choice(["version ", "build ", ""])),
                lambda: (rng.choice(words) + rng.choice(words), f"{rng.choice(keys)}{sign}"),
                lambda: (rand(alnum, 22), rng.choice(["image/", "https://cdn/", "cache "])),
            ])()
            out.append((value, f"{around[0]} {before}{quote if '=' in before or ':' in before else ''}", f" {around[1]}", path, 0))
    return out
