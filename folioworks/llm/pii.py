"""Op 7, personal data by weak supervision.

Base spans follow fixed patterns (emails, IP addresses, payment cards, phone numbers). Looser
patterns propose more candidates: spelled-out emails, numbers grouped with other separators,
phone numbers without a country code, and secrets (credentials with a name, long hexadecimal
strings). Labelers vote on every candidate and base span or abstain: its form, its length, the
gazetteer (gazetteer.json: domain endings, mail hosts, reserved address blocks, card prefixes,
calling codes), words before it, words after it, and the characters next to it.
Expectation-maximisation over the corpus-wide counts of vote patterns estimates each labeler's
reliability and each pattern's posterior. A logistic span classifier over hashed features of the
span's tokens and its context, which doesn't see the votes, is trained on the posteriors of at
most about SAMPLE spans, and decides which candidates are added.

What comes to the driver is bounded: counts of vote patterns (at most 3^LABELERS times two for
each kind) and the sample. Every pattern takes time in proportion to the text, also on runs of
digits, credentials and parts of addresses of any length, which are found whole.

Results: a null or empty text has no spans; base spans always stay, and added ones don't
overlap them; secrets are no personal data and stand in columns of their own (they can overlap
base spans); rows that repeat a doc_id get a result each; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from bisect import bisect_right
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioworks.llm import common

KINDS = ("email", "ip", "card", "phone")
SECRET = len(KINDS)
_NAMES = (*KINDS, "secret")
#: Spans that the classifier is trained on, half of them base spans.
SAMPLE = 20_000
#: Hashed features.
WIDTH = 1 << 12
LABELERS = 6
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Digits with single dots in between, as long as they go.
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Of a spelled-out email, what follows its first label.
_SPOKEN = (re.compile(r"(?:\s?[\[({]\s?(?:dot|DOT)\s?[\])}]\s?[A-Za-z0-9-]{2,}+)++"), re.compile(r"(?: (?:dot|DOT) [A-Za-z0-9-]{2,}+)++"))
#: What stands between its local part and that label.
_AT = (re.compile(r"\s?[\[({]?\s?(?:at|AT)\s?[\])}]?\s?$"), re.compile(r" (?:at|AT) $"))
_LOOSE = (
    (2, re.compile(r"(?<![0-9])[0-9]{4}([._/])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9])")),
    (3, re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")),
    (3, re.compile(r"(?<![0-9])00[1-9][0-9]{0,2}[ .-][0-9][0-9 .-]{6,14}[0-9](?![0-9])")),
)
#: Credentials of any length: a run of their characters is taken whole.
_SECRETS = (
    re.compile(r"(?i)(?<![a-z0-9])(?:token|key|apikey|secret|password|passwd|pwd)\s*+[:=]\s*+[\"']?([A-Za-z0-9+/_=.-]{12,}+)"),
    re.compile(r"(?<![A-Za-z0-9])([0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![A-Za-z0-9])"),
)
_GAZETTEER = json.loads(files(__package__).joinpath("gazetteer.json").read_text(encoding="utf-8"))
_ENDINGS, _HOSTS, _AGAINST, _UNITS = (frozenset(_GAZETTEER[x]) for x in ("domain_endings", "mail_hosts", "against", "units"))
_CUES = [frozenset(_GAZETTEER["cues"][k]) for k in _NAMES]
_BLOCKS, _PREFIXES, _CODES = (tuple(_GAZETTEER[x]) for x in ("reserved_blocks", "card_prefixes", "calling_codes"))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _octet(digits: str) -> bool:
    return len(digits) <= 3 and int(digits or 0) <= 255


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str):
    """Leftmost matches: what stands before an @ is its longest run of local characters after the match before."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def _local(c: str) -> bool:
    return c.isascii() and (c.isalnum() or c in "._%+-")


def _label(c: str) -> bool:
    return c.isascii() and (c.isalnum() or c == "-")


def _spoken(text: str):
    """Spelled-out emails, from their ends: each end's label, what stands for the @ before or in it, and the local part before that.

    Runs of characters are gone through once for an end, so the time is in proportion to the text, however long the parts.
    """
    for pattern, at in zip(_SPOKEN, _AT):
        done = 0
        for m in pattern.finditer(text):
            first = m.start()
            while first > done and _label(text[first - 1]):
                first -= 1
            between = at.search(text, max(done, first - 8), first) if first < m.start() else None
            stop = between.start() if between and between.end() == first else None
            if stop is None:  # nothing but at in the label itself
                label = text[first : m.start()]
                stop = max(label.rfind("at", 1, len(label) - 1), label.rfind("AT", 1, len(label) - 1))
                if pattern is not _SPOKEN[0] or stop < 0:
                    continue
                stop += first
            start = stop
            while start > done and _local(text[start - 1]):
                start -= 1
            while start < stop and not (text[start].isalnum() or text[start] == "_"):
                start += 1
            if start < stop:
                yield start, m.end()
                done = m.end()


def _dotted_fours(text: str):
    """The pattern's leftmost matches: of digits and dots as long as they go, four parts at a time; kept if all are at most 255."""
    for m in _DOTTED.finditer(text):
        parts = m[0].split(".")
        at = m.start()
        for n in range(0, len(parts) - 3, 4):
            four = parts[n : n + 4]
            end = at + sum(map(len, four)) + 3
            if all(_octet(x.lstrip("0")) for x in four):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By kind as listed, then start."""
    out = [("email", i, j) for i, j in _emails(text)]
    out += [("ip", i, j) for i, j in _dotted_fours(text)]
    for kind, pattern, low, high in (("card", _CARD, 13, 19), ("phone", _PHONE, 9, 15)):
        for m in pattern.finditer(text):
            digits = _digits(m[0])
            if low <= len(digits) <= high and (kind == "phone" or luhn(digits)):
                out.append((kind, *m.span()))
    return out


def _around(text: str, start: int, end: int) -> tuple[list[str], list[str]]:
    """The last three words before a span, and the first two after it."""
    return re.findall(r"[\w-]+", text[max(0, start - 40) : start].lower())[-3:], re.findall(r"[\w%-]+", text[end : end + 30].lower())[:2]


def votes(kind: int, text: str, start: int, end: int) -> tuple[int, ...]:
    """1 for, -1 against, 0 no vote: form, length, gazetteer, words before, words after, characters next to it."""
    span = text[start:end]
    digits = _digits(span)
    before, after = _around(text, start, end)
    if kind == 0:
        parts = re.split(r"@|\bat\b|\bAT\b", span)
        form = 1 if len(parts) == 2 and all(p.strip(" []{}()") for p in parts) else -1
        labels = [x.strip(" []{}()").lower() for x in re.split(r"[@.]|\b(?:at|AT|dot|DOT)\b", span)]
        size = 1 if 6 <= len(span) <= 100 else -1
        known = 1 if labels[-1] in _ENDINGS else 0
        known = max(known, int(any(x in _HOSTS for x in labels[1:-1])))
    elif kind == 1:
        form = 1 if not any(len(p) > 1 and p[0] == "0" for p in span.split(".")) else -1
        size = 1 if 9 <= len(span) <= 15 else 0
        known = -1 if any(span == x or span.startswith(f"{x}.") for x in _BLOCKS) else 0
    elif kind == 2:
        form = 1 if luhn(digits) else -1
        size = 1 if len(digits) in (15, 16) else -1
        known = 1 if digits.startswith(_PREFIXES) else -1
    elif kind == 3:
        form = 1 if 9 <= len(digits) <= 15 else -1
        size = 1 if 10 <= len(digits) <= 13 else 0
        bare = digits.removeprefix("00")
        known = (1 if bare.startswith(_CODES) else -1) if span[0] == "+" or len(bare) < len(digits) else (1 if digits[:1] not in ("0", "1") else -1)
    else:
        kinds = sum(bool(re.search(x, span)) for x in ("[a-z]", "[A-Z]", "[0-9]"))
        form = 1 if kinds >= 2 and len(set(span)) >= 8 else -1
        size = 1 if 20 <= len(span) <= 128 else 0
        known = 1 if re.search(r"[:=]\s*[\"']?$", text[max(0, start - 6) : start]) else -1
    cue = 1 if any(w in _CUES[kind] for w in before) else -1 if any(w in _AGAINST for w in before) else 0
    tail = -1 if any(w in _UNITS for w in after) else 0
    left, right = text[max(0, start - 1) : start], text[end : end + 1]
    apart = -1 if left.isalnum() or right.isalnum() or left in ("/", "_") or kind != SECRET and left == "=" else 1
    return form, size, known, cue, tail, apart


_RUNS = re.compile(r"[0-9]+|[a-z]+|[A-Z]+|[^0-9A-Za-z]")


def features(kind: int, text: str, start: int, end: int) -> list[int]:
    """Hashed features of a span's tokens and context."""
    span = text[start:end]
    before, after = _around(text, start, end)
    shape = "".join("9" if x[0].isdigit() else "a" if x[0].islower() else "A" if x[0].isupper() else x for x in _RUNS.findall(span))
    digits = _digits(span)
    left, right = text[max(0, start - 1) : start], text[end : end + 1]
    said = [
        "any", f"shape {shape[:24]}", f"size {(end - start) // 4}", f"digits {len(digits)}", f"first {digits[:2]}", f"last {re.split(r'[^A-Za-z0-9]+', span.lower())[-1][-6:]}",
        f"luhn {luhn(digits) if len(digits) < 20 else None}", f"left {'a' if left.isalpha() else '9' if left.isdigit() else left}", f"right {'a' if right.isalpha() else '9' if right.isdigit() else right}",
        *(f"before {w}" for w in before), *(f"after {w}" for w in after),
    ]
    return [zlib.crc32(f"{kind} {x}".encode()) % WIDTH for x in said]


def _number(kind: int, vote: tuple[int, ...], base: bool) -> int:
    """A vote pattern as one number."""
    out = kind * 2 + base
    for v in vote:
        out = out * 3 + v + 1
    return out


def _pattern(number: int) -> tuple[int, bool, list[int]]:
    vote = []
    for _ in range(LABELERS):
        vote.append(number % 3 - 1)
        number //= 3
    return number // 2, bool(number % 2), vote[::-1]


def candidates(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, base) of the base spans and of what the loose patterns find apart from them."""
    out = [(KINDS.index(k), i, j, True) for k, i, j in base_spans(text)] if re.search(r"[0-9@]", text) else []
    taken = sorted((i, j) for _, i, j, _ in out)
    spoken = [(0, _spoken(text))] if re.search(r"dot|DOT", text) else []
    for kind, spans in [*spoken, *((k, (m.span() for m in p.finditer(text))) for k, p in _LOOSE)]:
        starts, ends = [i for i, _ in taken], [j for _, j in taken]
        # taken spans of different kinds can overlap: the latest end so far tells whether one reaches in
        reach = np.maximum.accumulate(np.array(ends)).tolist() if ends else []
        new = []
        for i, j in sorted(spans):
            n = bisect_right(starts, j - 1)
            if (not n or reach[n - 1] <= i) and (not new or new[-1][1] <= i):
                new.append((i, j))
        out += ((kind, i, j, False) for i, j in new)
        taken = sorted(taken + new)
    secret = {m.span(1) for p in _SECRETS for m in p.finditer(text)}
    return out + [(SECRET, i, j, False) for i, j in sorted(secret)]


_SPANS = "array<struct<kind:int,start:int,end:int,pattern:int,features:array<int>>>"


def _spans(batches):
    kind = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("pattern", pa.int32()), ("features", pa.list_(pa.int32()))])
    for batch in batches:
        out = []
        for text in batch.column("text").to_pylist():
            out.append([{"kind": k, "start": i, "end": j, "pattern": _number(k, votes(k, text, i, j), base), "features": features(k, text, i, j)} for k, i, j, base in candidates(text)])
        yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("h"), pa.array(out, pa.list_(kind))], ["k", "h", "spans"])


def reliabilities(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Two-class EM over vote patterns (-1, 0, 1): each pattern's posterior, and (class, labeler, vote) likelihoods."""
    post = np.clip(0.5 + 0.2 * patterns.sum(1), 0.05, 0.95)
    like = np.zeros((2, patterns.shape[1], 3))
    for _ in range(rounds):
        for c, weight in ((0, (1 - post) * counts), (1, post * counts)):
            for v in range(3):
                like[c, :, v] = (weight[:, None] * (patterns == v - 1)).sum(0) + 1
            like[c] /= like[c].sum(1, keepdims=True)
        share = np.clip((post * counts).sum() / counts.sum(), 0.02, 0.98)
        log = np.stack([np.log(like[c])[np.arange(patterns.shape[1]), patterns + 1].sum(1) for c in range(2)])
        new = 1 / (1 + np.exp(np.clip(log[0] + np.log(1 - share) - log[1] - np.log(share), -30, 30)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return post, like


def posteriors(counts: dict[int, int]) -> dict[int, float]:
    """Of each vote pattern, by its number: the probability of personal data; base spans are known to be right."""
    if not counts:
        return {}
    numbers = sorted(counts)
    patterns = [_pattern(n) for n in numbers]
    post, _ = reliabilities(np.array([p[2] for p in patterns]), np.array([counts[n] for n in numbers], float))
    post = np.where([p[1] for p in patterns], np.maximum(post, 0.9), post)
    return dict(zip(numbers, post.tolist(), strict=True))


def fitted(rows: list[list[int]], target: np.ndarray, steps: int = 300, ridge: float = 1e-4) -> np.ndarray:
    """Weights of a logistic regression of probabilities on hashed features, by Adam steps."""
    weights = np.zeros(WIDTH)
    if not rows:
        return weights
    at, row = np.concatenate([np.array(x) for x in rows]), np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    one, two = np.zeros(WIDTH), np.zeros(WIDTH)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights[at], len(rows)), -30, 30)))
        slope = np.bincount(at, (p - target)[row], WIDTH) / len(rows) + ridge * weights
        one, two = 0.9 * one + 0.1 * slope, 0.999 * two + 0.001 * slope * slope
        weights -= 0.1 * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.999**step)) + 1e-8)
    return weights


def _reported(weights: np.ndarray, least: float):
    def accepted(span) -> bool:
        return 1 / (1 + np.exp(-np.clip(weights[span["features"]].sum(), -30, 30))) >= least

    def joined(spans) -> str:
        return ",".join(f"{_NAMES[a]}:{b}:{c}" for a, b, c in sorted(spans))

    schema = pa.schema([("k", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_secret", pa.int64()), ("secrets", pa.string()), ("n_found", pa.int64())])

    def run(batches):
        for batch in batches:
            out = []
            for k, rows in zip(batch.column("k").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                base, more = [], []
                for r in rows:
                    mine = _pattern(r["pattern"])[1]
                    if mine or accepted(r):
                        (base if mine else more).append((r["kind"], r["start"], r["end"]))
                secrets, more = [x for x in more if x[0] == SECRET], [x for x in more if x[0] != SECRET]
                number = [sum(a == i for a, _, _ in base) for i in range(len(KINDS))]
                out.append((k, *number, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(secrets), joined(secrets), len(base) + len(more) + len(secrets)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    return run


def personal_data(docs: DataFrame, least: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_secret, secrets, n_found (all)."""
    found = common.staged(common.keyed(docs).mapInArrow(_spans, f"k long, h long, spans {_SPANS}"), "pii")
    one = found.select("k", "h", F.explode("spans").alias("s"))
    counts = dict(one.groupBy("s.pattern").count().collect())  # a bounded number of patterns
    post = posteriors(counts)
    # base spans and candidates by a hash of the span, each at a rate that gives half of the sample
    base = F.floor(F.col("s.pattern") / 3**LABELERS) % 2 == 1
    total = [sum(c for n, c in counts.items() if _pattern(n)[1] == kind) for kind in (False, True)]
    rate = [sample / 2 / max(1, x) for x in total]
    mine = F.pmod(F.xxhash64("k", "h", "s.start", "s.kind"), F.lit(1 << 40)) / float(1 << 40)
    rows = one.where(mine < F.when(base, rate[1]).otherwise(rate[0])).select("s.pattern", "s.features").collect()
    weights = fitted([r["features"] for r in rows], np.array([post[r["pattern"]] for r in rows]))
    columns = "k long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long, secrets string, n_found long"
    out = found.mapInArrow(_reported(weights, least), columns)
    return out.select(common.doc_id(), *out.columns[1:])


def query(spark, sf_dir: str) -> DataFrame:
    return personal_data(common.table(spark, sf_dir, "documents"))
