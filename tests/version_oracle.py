"""Whether a version lies in a range, one at a time: what the engine's key intervals are held against."""

import re

_PART = re.compile(r"\d+|[a-z]+")


def parse(version: str) -> tuple | None:
    """Numbers and words in order, a release after its pre-releases; None if it has no number."""
    core, _, pre = version.strip().lower().split("+")[0].partition("-")
    if not re.fullmatch(r"v?\d+(\.\d+)*[a-z0-9.]*", core):
        return None
    nums = [int(x) for x in re.findall(r"\d+", core)][:4]
    words = [(0, int(p), "") if p.isdigit() else (1, 0, p) for p in _PART.findall(pre)]
    return tuple(nums + [0] * (4 - len(nums))), not pre, tuple(words)


def _semver_term(v, term: str) -> bool | None:
    m = re.fullmatch(r"(\^|~|>=|<=|>|<|=)?\s*(v?\d[\w.+-]*|\*)", term.strip())
    if not m:
        return None
    op, text = m[1] or "=", m[2]
    if text == "*":
        return True
    if re.search(r"\.[x*]$", text):
        op, text = "~" if text.count(".") > 1 else "^", re.sub(r"\.[x*].*$", "", text)
    w = parse(text)
    if w is None:
        return None
    if op == "^":
        lead = next((i for i, n in enumerate(w[0][:3]) if n), 2)
        top = tuple(n + 1 if i == lead else n if i < lead else 0 for i, n in enumerate(w[0]))
        return w <= v < (top, True, ())
    if op == "~":
        lead = min(text.count("."), 1)
        top = tuple(n + 1 if i == lead else n if i < lead else 0 for i, n in enumerate(w[0]))
        return w <= v < (top, True, ())
    return {"=": v == w, ">": v > w, ">=": v >= w, "<": v < w, "<=": v <= w}[op]


def _interval(v, text: str) -> bool | None:
    """[a,b), (,b], [a] and unions of those; a bare version is a lower bound."""
    parts = re.findall(r"[\[(][^\])]*[\])]", text)
    if not parts:
        w = parse(text)
        return None if w is None else v >= w
    known: list[bool | None] = []
    for p in parts:
        ends = [e.strip() for e in p[1:-1].split(",")]
        if len(ends) == 1:
            w = parse(ends[0])
            known.append(None if w is None else v == w)
            continue
        low, high = (parse(e) if e else None for e in ends[:2])
        if (ends[0] and low is None) or (ends[1] and high is None):
            known.append(None)
            continue
        fits_low = low is None or (v >= low if p[0] == "[" else v > low)
        fits_high = high is None or (v <= high if p[-1] == "]" else v < high)
        known.append(fits_low and fits_high)
    return True if True in known else None if None in known else False


def in_range(version: str | None, range_: str | None, dialect: str | None) -> bool | None:
    if range_ is None or range_.strip() in ("", "*", "any"):
        return True
    v = parse(version or "")
    if v is None or dialect == "opaque":
        return True if version == range_ else None
    if dialect == "maven":
        return _interval(v, range_)
    any_: list[bool | None] = []
    for choice in range_.split("||"):
        terms = [_semver_term(v, t) for t in re.findall(r"(?:[\^~]|[<>]=?|=)?\s*[\w.*+-]+", choice)]
        any_.append(False if False in terms else None if None in terms or not terms else True)
    return True if True in any_ else None if None in any_ else False
