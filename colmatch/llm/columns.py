"""What a catalogued column tells about itself: name tokens, table token, values.

Plain functions on single values, used inside Arrow batches.
"""

from __future__ import annotations

import re
import unicodedata

# Words that catalogues use for one another, and their usual short forms.
SYNONYMS = {
    "customer": "client cust cstmr", "order": "purchase ord", "product": "article item prod", "invoice": "bill invc inv",
    "shipment": "consignment shpmt shp", "supplier": "vendor suppl spl", "patient": "person pat", "visit": "encounter vst",
    "provider": "clinician prov", "carrier": "haulier carr hlr", "contract": "agreement ctr", "employee": "staff emp",
    "account": "ledger acct acc", "payment": "settlement pmt paymt", "policy": "cover pol", "container": "equipment cntr",
    "device": "sensor dev", "station": "stop stn", "route": "path rte", "branch": "office brnch", "warehouse": "depot whse wh",
    "vessel": "ship vsl", "service": "svc srv", "merchant": "shop mrch", "tax": "vat duty",
    "amount": "sum amt", "price": "cost prc", "quantity": "count cnt qty", "number": "no nbr num", "code": "kode cd",
    "name": "label nm", "date": "day dt", "timestamp": "time ts", "status": "state stat", "category": "class cat",
    "country": "nation ctry", "city": "town locality", "weight": "mass wgt", "unit": "measure uom", "rate": "ratio rt",
    "score": "points scr", "balance": "remainder bal", "limit": "cap lim", "flag": "indicator ind", "description": "text descr desc",
    "reference": "refno ref", "identifier": "id key",
}
QUALIFIERS = ("first last previous next current net gross total average local foreign internal external primary secondary "
              "opening closing planned actual expected confirmed shipping billing").split()
FILLERS = {"fld", "col", "f", "x", "stg"}
MISSING = {"", "n/a", "na", "null", "none", "-", "unknown", "?"}


def skeleton(word: str) -> str:
    """The first letter and the consonants, doubled letters once."""
    bare = word[:1] + re.sub("[aeiou]", "", word[1:])
    return re.sub(r"(.)\1+", r"\1", bare)


_CANON = {w: k for k, ws in SYNONYMS.items() for w in [*ws.split(), k]} | {q: q for q in QUALIFIERS}
_BY_SKELETON: dict[str, str] = {}
for _w, _k in _CANON.items():
    if len(_w) > 3:
        _BY_SKELETON.setdefault(skeleton(_w), _k)


def _one_edit(a: str, b: str) -> bool:
    """One letter more, less or other, or two neighbours swapped."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return a == b
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] or a[i:] == b[i + 1:] or a[i + 1:] == b[i:] or (a[i:i + 2] == b[i:i + 2][::-1] and a[i + 2:] == b[i + 2:])


def canonical(word: str) -> str | None:
    """The known word that ``word`` stands for: itself, a synonym, without vowels or misspelt; or None."""
    found = _CANON.get(word) or _BY_SKELETON.get(word) or (_BY_SKELETON.get(skeleton(word)) if len(word) > 4 else None)
    if found is None and len(word) > 4:
        found = next((k for w, k in _CANON.items() if len(w) > 4 and _one_edit(word, w)), None)
    return found


def name_tokens(name: str | None) -> tuple[list[str], list[str]]:
    """(known words in canonical form, other words as skeletons) of a column name."""
    text = unicodedata.normalize("NFKC", name or "")
    text = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", text)
    known, other = set(), set()
    for w in re.findall(r"[a-z]+", text.lower()):
        c = canonical(w)
        if w in FILLERS:
            continue
        if c:
            known.add(c)
        elif len(w) > 3:
            other.add(skeleton(w))
    return sorted(known), sorted(other)


def table_keys(name: str | None) -> list[str]:
    """What may be the distinguishing part of a table's name; none if it has none."""
    t = (name or "").strip().lower()
    t = t.rpartition(".")[2]
    if not t or re.fullmatch(r"t\d+", t):
        return []
    part = t.rpartition("_")[2]
    keys = {part}
    if "_" not in t and len(t) > 7:
        keys.add(t[4:])  # four letters of the subject before it
        keys |= {t[3:]} if t[:3] in _CANON else set()
    return sorted(k for k in keys if len(k) > 2)


_DATE = re.compile(r"((?:19|20)\d{2})([-/.]?)(0[1-9]|1[0-2])\2(0[1-9]|[12]\d|3[01])([ t]\d{2}:\d{2}\S*)?$")
_DATE_DMY = re.compile(r"(\d{1,2})([/.])(\d{1,2})[/.](\d{4})( \d{2}:\d{2}\S*)?$")
_GROUPED = re.compile(r"[+-]?\d{1,3}(?:,\d{3})+(\.\d+)?$")
_NUMBER = re.compile(r"[+-]?\d[\d ']*([.,]\d+)?$")
_CODE = re.compile(r"([a-z]{2,4})-\d{3,}$")


def _plain(v: str | None) -> str:
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", v or "")).strip().lower()


def _day_and_clock(s: str) -> tuple[str, str] | None:
    m = _DATE.match(s)
    if m:
        day, clock = "".join(m.group(1, 3, 4)), m[5]
    else:
        m = _DATE_DMY.match(s)
        if not m:
            return None
        a, b = int(m[1]), int(m[3])  # month first with slashes, day first with dots
        if m[2] == "." or a > 12:
            a, b = b, a
        day, clock = f"{m[4]}{a:02d}{b:02d}", m[5]
    clock = re.sub(r"[^0-9]", "", clock or "")[:6]
    return day, clock if clock.strip("0") else ""


def value_keys(v: str | None) -> list[str]:
    """A sample apart from its way of writing: kind letter and value; none for a missing one.

    A time of day gives a second key with the clock, as other sources may keep the day only.
    """
    s = _plain(v)
    if s in MISSING:
        return []
    when = _day_and_clock(s)
    if when:
        return ["d" + when[0], *(["s" + when[0] + when[1]] if when[1] else [])]
    if _GROUPED.match(s):
        s = s.replace(",", "")
    if _NUMBER.match(s):
        whole, _, part = re.sub("[ ']", "", s).replace(",", ".").partition(".")
        part = part.rstrip("0")
        sign = "-" if whole[0] == "-" else ""
        return ["n" + sign + (whole.lstrip("+-").lstrip("0") or "0") + (f".{part}" if part else "")]
    if s in ("true", "false", "yes", "no", "y", "t", "f"):
        return ["b" + s]
    return ["t" + (re.sub(r"[\W_]+", "", s) or s)]


def pattern_keys(samples: list[str | None], keys: list[str]) -> list[str]:
    """The prefix of codes and the range of long integers, as held by at least two samples."""
    seen: dict[str, int] = {}
    for v in samples:
        m = _CODE.match(_plain(v))
        if m:
            seen["c" + m[1]] = seen.get("c" + m[1], 0) + 1
    for k in keys:
        if k[0] == "n" and k[1:].isdigit() and len(k) >= 9:
            b = "i" + k[1:-5] + "/" + str(len(k))
            seen[b] = seen.get(b, 0) + 1
    return sorted(k for k, n in seen.items() if n > 1)


def kind_of(data_type: str | None, keys: list[str]) -> str:
    """What the values are: n(umber), d(ate), b(oolean), t(ext) or u(nknown)."""
    if keys:
        first = ["d" if k[0] == "s" else k[0] for k in keys]
        return max(sorted(set(first)), key=first.count)
    return {"integer": "n", "decimal": "n", "float": "n", "date": "d", "timestamp": "d", "boolean": "b", "text": "t"}.get((data_type or "").strip().lower(), "u")
