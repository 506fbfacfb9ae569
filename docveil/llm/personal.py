"""Personal data by weak supervision: labelers vote, EM rates them, a classifier decides."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docveil.shared import materialize

#: The first four are the base kinds; spans at one place are named in this order.
KINDS = ("email", "ip", "card", "phone", "iban", "national_id", "name", "secret")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A run of digits that does not lead to a match from its first digit does not from a later one.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the base pattern, found from each @ outwards: the local part is the run before it."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text[start - 1]):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            free = found.end()
        else:
            free = at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds in order."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out)


#: Candidates of the method: kind and pattern; each is tried only where its mark occurs.
_SECRET = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+(?![A-Za-z0-9_-])")
_NUMBER = re.compile(r"(?<![\w.+-])\(?[0-9]{2,5}(?:\)?[\x20.-]?\(?[0-9]{2,5}){1,4}(?![\w-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_HIDDEN = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]+(?:\x20?(?:\(dot\)|\[dot\]|\.)\x20?[A-Za-z0-9-]{2,})+")
_NAME = re.compile(r"(?<!\w)(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.?\x20[A-Z][a-z]{2,}(?:\x20[A-Z][a-z]{2,})?(?!\w)")
_TITLES = ("Mr", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Sr")

#: Gazetteer (fixed values): openings of well-known keys, given names, country codes of account numbers.
KEY_OPENINGS = ("AKIA", "ASIA", "ghp_", "gho_", "glpat-", "sk-", "sk_live_", "pk_live_", "xoxb-", "xoxp-", "AIza", "eyJ")
GIVEN_NAMES = frozenset("Anna Maria Marie Emma Sophie Laura Julia Sarah John James Robert Michael David Thomas Peter Paul Hans Karl Jean Pierre Michel Carlos Jose Juan Luis Pedro Ana Carmen Lucia Mary Linda Susan".split())
ACCOUNT_COUNTRIES = frozenset("AT BE CH DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split())
#: Context words (fixed values) by kind; looked for shortly before a candidate.
CONTEXT = {
    0: ("mail", "contact", "write", "kontakt"),
    3: ("tel", "phone", "call", "mobile", "fax", "ruf", "contact"),
    4: ("iban", "account", "konto", "compte", "cuenta"),
    5: ("ssn", "social security", "passport", "national id", "id no"),
    6: ("name", "contact", "dear", "sincerely", "von", "by"),
    7: ("token", "key", "secret", "password", "passwd", "auth", "bearer", "credential"),
}
_NOT_CONTEXT = ("version", "page", "isbn", "doi", "figure", "sha", "commit", "section", "order")

ABSTAIN, YES, NO = 0, 1, 2


def _format_vote(kind: int, s: str) -> int:
    """The regex labeler: the strict form of a kind."""
    if kind == 7:
        mixed = any(c.isdigit() for c in s) and any(c.isalpha() for c in s)
        if mixed and (re.fullmatch(r"[0-9a-f]{32,128}", s) or re.fullmatch(r"[0-9A-F]{32,128}", s) or (len(s) >= 24 and any(c.isupper() for c in s) and any(c.islower() for c in s))):
            return YES
        return NO if not mixed or s.count("-") > 3 else ABSTAIN
    if kind == 3:
        if re.fullmatch(r"\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}", s):
            return YES
        return NO if re.fullmatch(r"[0-9]{4}[.-][0-9]{2}[.-][0-9]{2}|[0-9]{2}[.-][0-9]{2}[.-][0-9]{4}|[0-9]{1,3}(\x20[0-9]{3})+", s) else ABSTAIN
    if kind == 4:
        plain = s.replace(" ", "")
        turned = plain[4:] + plain[:4]
        return YES if int("".join(str(int(c, 36)) for c in turned)) % 97 == 1 else NO
    if kind == 5:
        return NO if s[:3] in ("000", "666") or s[4:6] == "00" or s[-4:] == "0000" else YES
    return YES if kind == 0 else ABSTAIN


def _list_vote(kind: int, s: str) -> int:
    """The gazetteer labeler."""
    if kind == 7:
        return YES if s.startswith(KEY_OPENINGS) else ABSTAIN
    if kind == 6:
        return YES if any(w in GIVEN_NAMES for w in s.split()[1:]) else ABSTAIN
    if kind == 4:
        return YES if s[:2] in ACCOUNT_COUNTRIES else NO
    if kind == 0:
        return YES if s.lower().rstrip().endswith(("com", "org", "net", "edu", "de", "fr", "es", "dk")) else ABSTAIN
    return ABSTAIN


def _context_vote(kind: int, before: str) -> int:
    """The context labeler: what stands within some characters before."""
    before = before.lower()
    if any(w in before for w in CONTEXT[kind]):
        return YES
    return NO if any(w in before for w in _NOT_CONTEXT) else ABSTAIN


def _shape_vote(kind: int, s: str, before: str, after: str) -> int:
    """The surroundings labeler: assignments and quotes speak for a secret, arithmetic and units against numbers."""
    if kind == 7:
        return YES if re.search(r"[=:]\s*[\"']?$", before) else ABSTAIN
    if kind in (3, 5):
        return NO if before.rstrip()[-1:] in ("$", "€", "£", "=", "/", "*") or after.lstrip()[:1] in ("%", "$", "€", "£", "=") else ABSTAIN
    return ABSTAIN


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, pattern) of all spans that meet no base one, also those that overlap each other; pattern holds kind, votes and features.

    By start, longer ones first. Which of them stay is for settled() to say once they are judged: one that is rejected hides none.
    """
    found: list[tuple[int, int, int]] = []
    if _DIGIT.search(text):
        for m in _SECRET.finditer(text):
            if _DIGIT.search(m.group()):
                found.append((m.start(), 7, m.end()))
        for m in _NUMBER.finditer(text):
            s = m.group()
            n = sum(c.isdigit() for c in s)
            if re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", s):
                found.append((m.start(), 5, m.end()))
            elif 7 <= n <= 12 and n < len(s):
                found.append((m.start(), 3, m.end()))
        found += [(m.start(), 4, m.end()) for m in _IBAN.finditer(text)]
    if "(at)" in text or "[at]" in text:
        found += [(m.start(), 0, m.end()) for m in _HIDDEN.finditer(text)]
    if any(t in text for t in _TITLES):
        found += [(m.start(), 6, m.end()) for m in _NAME.finditer(text)]
    out, next_base = [], 0
    for start, kind, stop in sorted(found, key=lambda x: (x[0], -x[2], x[1])):
        while next_base < len(taken) and taken[next_base][2] <= start:
            next_base += 1
        if next_base < len(taken) and taken[next_base][0] < stop:
            continue
        s, before, after = text[start:stop], text[max(0, start - 30) : start], text[stop : stop + 3]
        votes = (_format_vote(kind, s), _list_vote(kind, s), _context_vote(kind, before), _shape_vote(kind, s, before, after))
        features = (min(3, len(s) // 12), int(before[-1:].isalnum()), min(3, 4 * sum(c.isdigit() for c in s) // len(s)))
        out.append((start, kind, stop, _pack(kind, votes, features)))
    return out


def _pack(kind: int, votes: tuple[int, ...], features: tuple[int, ...]) -> int:
    code = kind
    for v in (*votes, *features):
        code = code * 4 + v
    return code


def _unpack(code: int) -> tuple[int, tuple[int, ...], tuple[int, ...]]:
    rest = []
    for _ in range(7):
        code, v = divmod(code, 4)
        rest.append(v)
    rest.reverse()
    return code, tuple(rest[:4]), tuple(rest[4:])


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over vote patterns: P(vote | personal or not) for each labeler, and each pattern's posterior.

    votes: patterns x labelers of ABSTAIN, YES, NO. Starts from labelers that are
    mostly right; one pseudo-count per vote keeps rates inside (0, 1).
    """
    labelers = votes.shape[1]
    theta = np.tile(np.array([[0.4, 0.1, 0.5], [0.4, 0.5, 0.1]]), (labelers, 1, 1))  # labeler, class, vote
    prior = 0.5
    post = np.full(len(votes), 0.5)
    for _ in range(rounds):
        like = np.log([1 - prior, prior])[None, :] + sum(np.log(theta[j][:, votes[:, j]]).T for j in range(labelers))
        like -= like.max(1, keepdims=True)
        p = np.exp(like)
        new = p[:, 1] / p.sum(1)
        done = np.abs(new - post).max(initial=0) < 1e-9
        post = new
        for j in range(labelers):
            for v in range(3):
                hit = counts * (votes[:, j] == v)
                theta[j, :, v] = [(hit * (1 - post)).sum() + (2.0 if v == NO else 1.0), (hit * post).sum() + (2.0 if v == YES else 1.0)]
            theta[j] /= theta[j].sum(1, keepdims=True)
        prior = float(np.clip(((counts * post).sum() + 1) / (counts.sum() + 2), 0.02, 0.98))
        if done:
            break
    return theta, post, prior


def _design(codes: list[int]) -> np.ndarray:
    """Indicator features of the final classifier: kind, each vote, each feature's value."""
    rows = np.zeros((len(codes), 1 + len(KINDS) + 12 + 12))
    for k, code in enumerate(codes):
        kind, votes, features = _unpack(code)
        rows[k, 0] = 1
        rows[k, 1 + kind] = 1
        for j, v in enumerate(votes):
            rows[k, 1 + len(KINDS) + 3 * j + v] = 1
        for j, v in enumerate(features):
            rows[k, 13 + len(KINDS) + 4 * j + v] = 1
    return rows


def train(found: dict[int, int], rounds: int = 30, ridge: float = 1.0) -> dict[int, float]:
    """Each pattern's probability of being personal, by the final classifier.

    A logistic regression (Newton's method with a ridge) on the posteriors
    that EM gives. found counts the patterns of all candidates of all documents.
    """
    codes = sorted(found)
    if not codes:
        return {}
    counts = np.array([found[c] for c in codes], float)
    votes = np.array([_unpack(c)[1] for c in codes])
    _, target, _ = reliabilities(votes, counts)
    x, weight = _design(codes), counts / counts.mean()
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (p - target)) + ridge * 0.01 * beta
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * 0.01 * np.eye(len(beta))
        step = np.linalg.solve(hess, grad)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return dict(zip(codes, (1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))).tolist(), strict=True))


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64())])
_CAND = pa.struct([*_SPAN, pa.field("pattern", pa.int32())])
_SCAN = "base array<struct<start:long,kind:int,stop:long>>, more array<struct<start:long,kind:int,stop:long,pattern:int>>"


def _scan(texts: pa.Array) -> pa.Array:
    base, more = [], []
    for t in texts:
        text = t.as_py() or ""
        spans = base_spans(text)
        base.append([{"start": a, "kind": k, "stop": b} for a, k, b in spans])
        more.append([{"start": a, "kind": k, "stop": b, "pattern": p} for a, k, b, p in candidates(text, spans)])
    return pa.StructArray.from_arrays([pa.array(base, pa.list_(_SPAN)), pa.array(more, pa.list_(_CAND))], ["base", "more"])


def _said(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"], F.lit(":"), s["stop"])), ",")


def _count(kind: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def _bitmap(patterns: list[int]) -> Column:
    """Patterns as bits of a constant array, so a look-up costs the same however many there are."""
    words = [0] * (len(KINDS) * 4**7 // 64)
    for c in patterns:
        words[c // 64] |= 1 << c % 64
    return F.array(*(F.lit(w - (1 << 64) if w >> 63 else w).cast("long") for w in words))


def settled(found: Column) -> Column:
    """Of spans by start, longer ones first, those that begin behind the last one that stays."""

    def step(kept: Column, s: Column) -> Column:
        return F.when(s["start"] < F.coalesce(F.try_element_at(kept, F.lit(-1))["stop"], F.lit(0)), kept).otherwise(F.concat(kept, F.array(s)))

    return F.aggregate(found, F.array().cast("array<struct<start:bigint,kind:int,stop:bigint>>"), step)


def find_personal(docs: DataFrame, accept: float = 0.5, key: str = "doc_id") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans, span_list) for every row.

    Base spans follow fixed patterns and always stay. Beside them, candidates
    get votes of four labelers; counts of vote patterns over all documents, at
    most some thousand rows, train the classifier, and of the candidates of at
    least accept the leftmost, longest ones become spans. A null counts as an empty text. Positions are code
    points. Repeated rows come back as often; other columns are not read; an empty table gives an empty one.
    """
    scanned = materialize(docs.select(F.col(key), F.arrow_udf(_scanner(), _SCAN)(F.col("text").cast("string")).alias("s")).select(key, "s.*"), "spans")
    found = dict(scanned.select(F.explode("more").alias("m")).groupBy("m.pattern").count().collect())
    good = [c for c, p in train(found).items() if p >= accept]
    chosen = F.filter("more", lambda m: F.getbit(F.element_at(_bitmap(good), F.floor(m["pattern"] / 64).cast("int") + 1), m["pattern"] % 64) == 1)
    plain = F.transform(chosen, lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["stop"].alias("stop")))
    every = F.array_sort(F.concat("base", settled(plain)))
    counts = [_count(k).alias(f"n_{KINDS[k]}") for k in range(4)]
    return scanned.select(key, *counts, F.sha2(_said(F.col("base")).cast("binary"), 256).alias("base_sha256"), _said(every).alias("spans"), every.alias("span_list"))


def _scanner():
    def scan(texts: pa.Array) -> pa.Array:
        return _scan(texts)

    return scan
