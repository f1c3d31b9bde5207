"""The notes of functions.generate for a whole batch of keys at a time, on arrays.

The same rules, draws and templates as the SQL there, which stays the definition (a test compares
the two).  A note draws only what its scenario's template names, and all draws of a batch are
digested together: MD5 runs over arrays of messages, word by word.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np

from . import generate as G

_SHIFTS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
#: Messages that are digested together: their arrays stay in a core's cache.
CHUNK = 8192


def _md5_head(words: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The first four bytes of the MD5 of one-block messages, as a big-endian number.

    words: a row for each of the words that are not zero throughout, in order; bits: message lengths.
    """
    n, used = words.shape[1], words.shape[0]
    a, b, c, d = (np.full(n, x) for x in _START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(61):  # the last three rounds leave the first register alone
        turn, at = divmod(i, 16)
        if turn == 0:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
            g = at
        elif turn == 1:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
            g = (5 * at + 1) % 16
        elif turn == 2:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
            g = (3 * at + 5) % 16
        else:
            np.bitwise_not(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
            g = (7 * at) % 16
        np.add(f, a, out=f)
        np.add(f, _SINES[i], out=f)
        if g < used:
            np.add(f, words[g], out=f)
        elif g == 14:
            np.add(f, bits, out=f)
        s = _SHIFTS[turn][i % 4]
        np.left_shift(f, np.uint32(s), out=t), np.right_shift(f, np.uint32(32 - s), out=f), np.bitwise_or(f, t, out=f)
        np.add(f, b, out=f)
        a, b, c, d, f = d, f, b, c, a
    # round 60 put the last sum where b stands now
    return (b + _START[0]).byteswap()


def digest_heads(groups: list[tuple[np.ndarray, bytes]]) -> list[np.ndarray]:
    """For each (prefixes, suffix) the first 32 bits of MD5(prefix + suffix), as uint32.

    prefixes: a matrix of bytes, a row for each prefix of one length.
    """
    longest = max((p.shape[1] + len(s) for p, s in groups if len(p)), default=0)
    if longest > 55:
        return [np.array([int.from_bytes(hashlib.md5(r.tobytes() + s).digest()[:4], "big") for r in p], np.uint32) for p, s in groups]
    wide = (longest + 4) // 4
    total = sum(len(p) for p, _ in groups)
    message, bits, at = np.zeros((total, 4 * wide), np.uint8), np.empty(total, np.uint32), 0
    for p, s in groups:
        rows, k = slice(at, at + len(p)), p.shape[1]
        message[rows, :k] = p
        message[rows, k : k + len(s)] = np.frombuffer(s, np.uint8)
        message[rows, k + len(s)] = 0x80
        bits[rows] = 8 * (k + len(s))
        at += len(p)
    words, out = message.view("<u4"), np.empty(total, np.uint32)
    for a in range(0, total, CHUNK):
        out[a : a + CHUNK] = _md5_head(np.ascontiguousarray(words[a : a + CHUNK].T), bits[a : a + CHUNK])
    return np.split(out, np.cumsum([len(p) for p, _ in groups])[:-1]) if groups else []


def _strings(values) -> np.ndarray:
    out = np.empty(len(values), object)
    out[:] = list(values)
    return out


_NUMBERS = _strings([str(x) for x in range(15000)])
_PADDED = {n: _strings([str(x).zfill(n) for x in range(10**n)]) for n in (2, 3, 4)}
_LETTERS = _strings("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: The days that notes may name, and then some.
_FIRST_DAY, _LAST_DAY = np.datetime64("2005-01-01"), np.datetime64("2027-12-31")
_SESSION, _TODAY = (int((np.datetime64(x) - _FIRST_DAY).astype(int)) for x in ("2025-10-01", "2025-11-30"))


@functools.cache
def _dates() -> tuple[np.ndarray, np.ndarray]:
    """The five forms of each day, one after the other, and the days as MM/DD/YYYY."""
    forms, padded = [], []
    for day in np.arange(_FIRST_DAY, _LAST_DAY).tolist():
        y, m, d = day.year, day.month, day.day
        forms += [f"{m}/{d}/{y}", f"{m}/{d:02}/{y}", f"{m:02}/{d:02}/{y}", f"{m}/{d}/{y % 100}", f"{G.MONTHS[m - 1]} {d}, {y}"]
        padded.append(f"{m:02}/{d:02}/{y}")
    return _strings(forms), _strings(padded)


def _pool(values) -> np.ndarray:
    return _pools(tuple(values))


@functools.cache
def _pools(values: tuple[str, ...]) -> np.ndarray:
    return _strings(values)


class _Fields:
    """The columns of generate.fields_sql for keys of one scenario, each made when first asked for.

    draw(field): the 32 bits of each key for that field, as int64.
    """

    def __init__(self, draw):
        self.u, self.made = draw, {}

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self.made:
            self.made[name] = getattr(self, "_" + name)()
        return self.made[name]

    def pick(self, values, field: str) -> np.ndarray:
        return _pool(values)[self.u(field) % len(values)]

    def person(self, field: str) -> np.ndarray:
        return self.pick(G.PARENTS, field + "f") + " " + self.pick(G.LAST, field + "l")

    def phone(self, field: str) -> np.ndarray:
        return "315-" + _NUMBERS[200 + self.u(field) % 700] + "-" + _PADDED[4][self.u(field + "n") % 10000]

    def date(self, day: np.ndarray, field: str) -> np.ndarray:
        return _dates()[0][5 * day + self.u(field) % 5]

    @staticmethod
    def clock(hour: np.ndarray, minute: np.ndarray) -> np.ndarray:
        return _NUMBERS[(hour + 11) % 12 + 1] + ":" + _PADDED[2][minute] + _pool([" AM", " PM"])[(hour >= 12).astype(int)]

    def slot(self, kind: str, field: str, low: int, n: int) -> np.ndarray:
        """The text of a template's slot, for each key."""
        if kind == "field":
            return self[field]
        if kind == "date":
            return self.date(self["session_day"] + low + self.u(field) % n, field + "form")
        if kind == "clock":
            return self.clock(8 + self.u(field) % 11, self.u(field + "m") % 60)
        if kind == "num":
            return _NUMBERS[low + self.u(field) % n]
        if kind == "person":
            return self.person(field)
        if kind == "nurse":
            return self.person(field) + ", RN"
        return self.pick({"drug": G.DRUGS, "ill": G.DIAGNOSES}[kind], field)

    _first = lambda self: self.pick(G.FIRST, "first")
    _last = lambda self: self.pick(G.LAST, "last")
    _parent1 = lambda self: self.pick(G.PARENTS, "parent1")
    _phone = lambda self: self.phone("ph1")
    _phone2 = lambda self: self.phone("ph2")
    _phone3 = lambda self: self.phone("ph3")
    _staff_name = lambda self: self.person("staff")
    _location = lambda self: self.pick(G.LOCATIONS, "location")
    _program = lambda self: _pool(G.PROGRAMS)[self["program_no"]]
    _aide = lambda self: self.person("aide")
    _ot = lambda self: self.person("ot")
    _slp = lambda self: self.person("slp")
    _peer1 = lambda self: self.pick(G.FIRST, "peer1")
    _peer2 = lambda self: self.pick(G.FIRST, "peer2")
    _p1 = lambda self: _NUMBERS[1000 + self.u("p1") % 9000]
    _p2 = lambda self: _NUMBERS[10 + self.u("p2") % 80]
    _d2digits = lambda self: _PADDED[2][self.u("d2digits") % 100] + "0"
    _session_day = lambda self: _SESSION + self.u("session") % 60
    _session = lambda self: _dates()[1][self["session_day"]]
    _hour = lambda self: np.array([9, 10, 13, 14, 15])[self.u("hour") % 5]
    _length = lambda self: np.array([60, 90, 120])[self.u("minutes") % 3]
    _minutes = lambda self: _NUMBERS[self["length"]]
    _begin = lambda self: self.clock(self["hour"], 0 * self["hour"])
    _finish = lambda self: self.clock(self["hour"] + self["length"] // 60, self["length"] % 60)
    _dob = lambda self: self.date(_TODAY - (365 * (3 + self.u("age") % 16) + self.u("days") % 365), "dobform")
    _d1 = lambda self: self.date(self["session_day"] + 30 + self.u("d1") % 61, "d1form")
    _d2 = lambda self: self.date(self["session_day"] + 2, "d2form")
    _d3 = lambda self: self.date(self["session_day"] - (2 + self.u("d3") % 4), "d3form")
    _program_no = lambda self: self.u("program") % len(G.PROGRAMS)
    _has_home = lambda self: self.u("hasaddr") % 10 < 3
    _credentialed = lambda self: self.u("staffkind") % 10 < 8
    _parent2 = lambda self: np.where(self.u("hasp2") % 10 < 4, self.pick(G.PARENTS, "parent2") + " " + self["last"], "")
    _and_parent2 = lambda self: np.where(self["parent2"] == "", "", " and " + self["parent2"])
    _parent2_line = lambda self: np.where(self["parent2"] == "", "", "; also " + self["parent2"])

    def _other_program(self):
        at = self.u("other") % (len(G.PROGRAMS) - 1)
        return _pool(G.PROGRAMS)[at + (at >= self["program_no"])]

    def _name(self):
        first, last, form = self["first"], self["last"], self.u("nameform") % 4
        mi = np.where(self.u("hasmi") % 10 < 4, " " + self.pick(G.INITIALS, "mi") + ".", "")
        turned = last + ", " + first
        return np.where(form == 1, turned, np.where(form == 2, turned + mi, np.where(form == 3, first + mi + " " + last, first + " " + last)))

    def _medicaid(self):
        digits = self.u("m3") % 1000000
        return _LETTERS[self.u("m1") % 26] + _LETTERS[self.u("m2") % 26] + _PADDED[3][digits // 1000] + _PADDED[3][digits % 1000]

    def _home(self):
        return _NUMBERS[1 + self.u("house") % 980] + " " + self.pick(G.STREETS, "street") + ", " + self.pick(G.TOWNS, "town") + ", NY " + _NUMBERS[13000 + self.u("zip") % 999]

    def _address(self):
        other = _NUMBERS[100 + self.u("fallback") % 900] + " " + self.pick(G.FALLBACK_STREETS, "fallbackstreet") + ", Syracuse, NY 13204"
        return np.where(self["has_home"], self["home"], other)

    def _residence(self):
        return np.where(self["has_home"], self["home"], "100 Geiger Road, Syracuse, NY 13204")

    def _provider(self):
        return np.where(self.u("prov") % 10 < 7, "Dr. " + self.pick(G.LAST, "provl"), self.person("prov") + ", " + self.pick(["MD", "NP", "RN"], "provc"))

    def _staff_title(self):
        return np.where(self["credentialed"], "Behavior Specialist", _pool(t for t, _ in G.TITLES)[self.u("title") % 7])

    def _staff_cred(self):
        return np.where(self["credentialed"], self.pick(G.CREDENTIALS, "staffcred"), _pool(c for _, c in G.TITLES)[self.u("title") % 7])


@functools.cache
def _template(scenario: str) -> tuple[str, list[tuple[str, str, int, int]], list[str]]:
    """A template as a format, its slots, and the fields that these draw."""
    text, slots, drawn = "", [], {}
    for before, kind, field, low, n in G._parts(G.TEMPLATES[scenario]):
        text += before.replace("\\", "").replace("%", "%%")
        if kind:
            text += "%s"
            slots.append((kind, list(G._FIELDS)[low - 1] if kind == "field" else field, low, n))
    none = _Fields(lambda field: drawn.setdefault(field, np.zeros(0, np.int64)))
    for slot in slots:
        none.slot(*slot)
    return text, slots, list(drawn)


def _prefixes(keys: np.ndarray, seed) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix of bytes "seed|key|") of the keys, by length."""
    out, text = [], [f"{seed}|{k}|".encode() for k in keys.tolist()]
    sizes = np.fromiter(map(len, text), np.int64, len(text))
    for n in np.unique(sizes).tolist():
        places = np.flatnonzero(sizes == n)
        out.append((places, np.frombuffer(b"".join(text[p] for p in places.tolist()), np.uint8).reshape(-1, n)))
    return out


def note_texts(keys: np.ndarray, seed=42) -> np.ndarray:
    """The text of each key's note."""
    names = [n for n, _ in G.SCENARIOS]
    bounds = np.cumsum([w for _, w in G.SCENARIOS])
    parts = _prefixes(keys, seed)
    groups, wanted = [], []
    for (places, prefix), draw in zip(parts, digest_heads([(p, b"scenario") for _, p in parts]), strict=True):
        scenario = np.searchsorted(bounds, draw % 105, "right")
        for s in np.unique(scenario).tolist():
            own = scenario == s
            groups.append((s, places[own]))
            wanted.append((prefix[own], _template(names[s])[2]))
    heads = iter(digest_heads([(p, f.encode()) for p, fields in wanted for f in fields]))
    out = np.empty(len(keys), object)
    for (s, places), (_, fields) in zip(groups, wanted, strict=True):
        draws = {f: next(heads).astype(np.int64) for f in fields}
        text, slots, _ = _template(names[s])
        columns = _Fields(draws.__getitem__)
        values = [columns.slot(*slot).tolist() for slot in slots]
        out[places] = [text % row for row in zip(*values, strict=True)]
    return out
