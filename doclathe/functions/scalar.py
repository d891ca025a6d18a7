"""Scalar columns: key patterns, semantic detectors, the counter PRNG and the format generators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Key patterns in order of precedence. `\z` is the true end of input.
KEY_PATTERNS: dict[str, str] = {
    "UUID": r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z",
    "OBJECTID": r"^[0-9a-f]{24}\z",
    "ULID": r"^[0-9A-Z]{26}\z",
    "NUMERIC_ID": r"^[0-9]{6,20}\z",
    "PREFIXED_ID": r"^(user|doc|item|order)_[a-z0-9]{8,32}\z",
}

# Value patterns of the semantic detectors.
EMAIL = r"(?i)[a-z0-9!#$%&'*+/=?^_`{|}~-]+(\.[a-z0-9!#$%&'*+/=?^_`{|}~-]+)*@([a-z0-9]([a-z0-9-]*[a-z0-9])?\.)+[a-z0-9]([a-z0-9-]*[a-z0-9])?"
URL = r"^https?://.+"
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"
OBJECTID = r"(?i)^[0-9a-f]{24}\z"
PHONE_NOISE = r"[\s.\-()]"
PHONE = r"^(\+?[0-9]{1,3})?[0-9]{7,15}\z"
PERSON = r"^[A-Za-z\s\-'.]+\z"
IPV4 = r"^([0-9]{1,3}\.){3}[0-9]{1,3}\z"


def ipv6(v: Column) -> Column:
    """Eight groups of hexadecimal digits, one run of them shortened to `::`, or a dotted tail for the last two, and a zone.

    Counted rather than spelt out as alternatives: at most one `::`, the right number of groups, each of 1 to 4 digits."""
    bare = F.regexp_replace(v, r"%[0-9a-zA-Z]+\z", "")
    dotted = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}\z"
    plain = F.regexp_replace(bare, r":" + dotted, ":0:0")
    groups = F.size(F.filter(F.split(plain, ":"), lambda g: g != ""))
    shape = plain.rlike(r"^(?i)([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?(::([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?)?\z")
    short = F.instr(plain, "::") > 0
    return shape & F.when(short, groups <= 7).otherwise(groups == 8)


@dataclass(frozen=True)
class Detector:
    """A semantic type: a gate on the field's name or path, a test of values, and how many must pass."""

    name: str
    gates: tuple[str, ...]
    test: Callable[[Column], Column]
    confidence: float
    priority: int
    format: str | None = None

    def applies(self, path: str) -> bool:
        import re

        leaf = path.rsplit(".", 1)[-1].removesuffix("[]")
        return any(re.search(g, x, re.I) for g in self.gates for x in (leaf, path))


def _like(rx: str) -> Callable[[Column], Column]:
    return lambda v: v.rlike(rx)


# Name gates, least ratios and priorities.
DETECTORS: tuple[Detector, ...] = (
    Detector("Email", ("email", "e_?mail"), _like(EMAIL), 0.8, 1, "email"),
    Detector("URL", ("url", "link", "href", "website", "endpoint"), _like(URL), 0.8, 2, "url"),
    Detector("UUID", ("uuid", "guid"), _like(UUID), 0.9, 3, "uuid"),
    Detector("ObjectID", ("_id$", "oid$", "object_?id"), _like(OBJECTID), 0.9, 3, "objectid"),
    Detector("Phone", ("phone", "mobile", "tel", "fax"), lambda v: F.regexp_replace(v, PHONE_NOISE, "").rlike(PHONE), 0.7, 4, "phone"),
    Detector("PersonName", ("^(first|last|full)_?name$", "^name$", "author", "^(created|updated)_?by$"), lambda v: F.length(v).between(2, 50) & v.rlike(PERSON), 0.6, 5, "person-name"),
    Detector("IPv4", ("ip_?addr", "ip_?address", "ipv4", "client_ip"), _like(IPV4), 0.9, 6, "ipv4"),
    Detector("IPv6", ("ip_?addr", "ip_?address", "ipv6", "client_ip"), ipv6, 0.9, 7, "ipv6"),
)


def found(pattern: str, name: str) -> bool:
    """Whether a name known to the driver has a match of a pattern."""
    import re

    return re.search(pattern.replace(r"\z", r"\Z"), name) is not None


def seed_of(text: str | int) -> int:
    """A string seed's number: the first 32 bits of its SHA-256; numbers stand for themselves."""
    import hashlib

    return text if isinstance(text, int) else int(hashlib.sha256(text.encode()).hexdigest()[:8], 16)


def seed_column(text: Column) -> Column:
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("long")


def digest(seed: int | str, row: Column, path: str, *more: Column) -> Column:
    """32 hexadecimal digits that depend on seed, row and path alone: any partitioning draws the same."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), row.cast("string"), F.lit(path), *[m.cast("string") for m in more]))


def uniform(seed: int | str, row: Column, path: str, *more: Column) -> Column:
    """In [0, 1)."""
    return F.conv(F.substring(digest(seed, row, path, *more), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def below(n: int | Column, seed: int | str, row: Column, path: str, *more: Column) -> Column:
    """An integer in [0, n)."""
    return F.floor(uniform(seed, row, path, *more) * n).cast("long")


#: The fixed instant that generated times count back from.
REFERENCE = 1735689600
# Small vocabularies for generated text.
WORDS = ("amber", "birch", "cedar", "delta", "ember", "fjord", "grove", "haven", "iris", "jade", "karst", "lotus", "maple", "north", "opal", "pearl")
FIRST = ("Ada", "Ben", "Cleo", "Dan", "Eva", "Finn", "Gita", "Hugo", "Ines", "Jon", "Kira", "Leo", "Mona", "Nils", "Olga", "Paul")
LAST = ("Abel", "Brandt", "Costa", "Diaz", "Evans", "Fischer", "Garcia", "Hale", "Ivanov", "Jansen", "Klein", "Lopez", "Moreau", "Novak", "Olsen", "Price")
DOMAINS = ("example.com", "example.org", "example.net", "mail.test", "post.test")


def pick(words: tuple[str, ...], seed: int | str, row: Column, path: str, *more: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (below(len(words), seed, row, path, *more) + 1).cast("int"))


def _uuid(seed, row, path, *more) -> Column:
    d = digest(seed, row, path, *more)
    return F.concat(F.substring(d, 1, 8), F.lit("-"), F.substring(d, 9, 4), F.lit("-4"), F.substring(d, 14, 3), F.lit("-a"), F.substring(d, 18, 3), F.lit("-"), F.substring(d, 21, 12))


def _objectid(seed, row, path, *more) -> Column:
    when = F.lit(REFERENCE) - below(31536000, seed, row, path + "#t", *more)
    return F.concat(F.lpad(F.lower(F.hex(when)), 8, "0"), F.substring(digest(seed, row, path, *more), 1, 16))


def _datetime(seed, row, path, *more) -> Column:
    when = F.timestamp_seconds(F.lit(REFERENCE) - below(31536000, seed, row, path, *more))
    return F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _decimal(seed, row, path, *more) -> Column:
    return (below(100000000, seed, row, path, *more).cast("decimal(18,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(12,2)").cast("string")


def _octets(seed, row, path, *more) -> Column:
    d = digest(seed, row, path, *more)
    return F.concat_ws(".", *[F.conv(F.substring(d, 2 * i + 1, 2), 16, 10) for i in range(4)])


def _groups(seed, row, path, *more) -> Column:
    d = digest(seed, row, path, *more)
    return F.concat_ws(":", *[F.substring(d, 4 * i + 1, 4) for i in range(8)])


def _email(seed, row, path, *more) -> Column:
    return F.concat(F.lower(pick(FIRST, seed, row, path, *more)), F.substring(digest(seed, row, path, *more), 25, 4), F.lit("@"), pick(DOMAINS, seed, row, path + "#d", *more))


FORMATS: dict[str, Callable[..., Column]] = {
    "objectid": _objectid,
    "date-time": _datetime,
    "uuid": _uuid,
    "decimal": _decimal,
    "base64": lambda s, r, p, *m: F.base64(F.substring(digest(s, r, p, *m), 1, 16).cast("binary")),
    "email": _email,
    "url": lambda s, r, p, *m: F.concat(F.lit("https://"), pick(WORDS, s, r, p, *m), F.lit("."), pick(DOMAINS, s, r, p + "#d", *m), F.lit("/"), F.substring(digest(s, r, p, *m), 1, 8)),
    "phone": lambda s, r, p, *m: F.concat(F.lit("+1-555-"), F.lpad(below(1000, s, r, p + "#a", *m).cast("string"), 3, "0"), F.lit("-"), F.lpad(below(10000, s, r, p, *m).cast("string"), 4, "0")),
    "person-name": lambda s, r, p, *m: F.concat_ws(" ", pick(FIRST, s, r, p, *m), pick(LAST, s, r, p + "#l", *m)),
    "ipv4": _octets,
    "ipv6": _groups,
}


@dataclass
class Registry:
    """Generators of one's own: by path (`*.email` for any parent), then by type, then the format's."""

    paths: dict[str, Callable[..., Column]] = field(default_factory=lambda: {"*.email": _email, "email": _email, "*._id": _objectid})
    types: dict[str, Callable[..., Column]] = field(default_factory=dict)
    formats: dict[str, Callable[..., Column]] = field(default_factory=lambda: dict(FORMATS))

    def register_format(self, name: str, make: Callable[..., Column]) -> None:
        self.formats[name] = make

    def register_path(self, path: str, make: Callable[..., Column]) -> None:
        self.paths[path] = make

    def register_type(self, name: str, make: Callable[..., Column]) -> None:
        self.types[name] = make

    def find(self, path: str, typ: str | None) -> Callable[..., Column] | None:
        leaf = "*." + path.rsplit(".", 1)[-1]
        return self.paths.get(path) or (self.paths.get(leaf) if "." in path else None) or self.types.get(typ or "")

    @classmethod
    def load(cls, module: str) -> Registry:
        """From a module with `path_generators` and `type_generators`."""
        import importlib

        m, r = importlib.import_module(module), cls()
        r.paths |= getattr(m, "path_generators", {})
        r.types |= getattr(m, "type_generators", {})
        return r


# Keys of dynamic objects. Row and ordinal are in the digest, and numbers carry the ordinal, so keys of one object differ by construction.
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def _base32(n: Column, width: int) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(width - 1), F.lit(0), F.lit(-1)), lambda i: F.substr(F.lit(CROCKFORD), (F.floor(n / F.pow(F.lit(32.0), i)) % 32 + 1).cast("int"), F.lit(1))), "")


def _ulid(seed, row, path, *more) -> Column:
    when = (F.lit(REFERENCE) - below(31536000, seed, row, path + "#t", *more)).cast("double") * 1000
    return F.concat(_base32(when, 10), F.upper(F.substring(digest(seed, row, path, *more), 1, 16)))


def _numeric(seed, row, path, *more) -> Column:
    """16 drawn digits, then the ordinal's last four: keys of one object differ by construction, those of different objects but for a chance of 1 in 10^16 a pair."""
    d = digest(seed, row, path, *more)
    part = lambda at: F.lpad((F.conv(F.substring(d, at, 12), 16, 10).cast("decimal(20,0)") % 100000000).cast("long").cast("string"), 8, "0")
    return F.concat(part(1), part(13), *[F.lpad((m % 10000).cast("string"), 4, "0") for m in more[-1:]])


KEYS: dict[str, Callable[..., Column]] = {
    "UUID": _uuid,
    "OBJECTID": _objectid,
    "ULID": _ulid,
    "NUMERIC_ID": _numeric,
    "PREFIXED_ID": lambda s, r, p, *m: F.concat(pick(("user", "doc", "item", "order"), s, r, p, *m), F.lit("_"), F.substring(digest(s, r, p, *m), 1, 16)),
    "CUSTOM": lambda s, r, p, *m: F.substring(digest(s, r, p, *m), 1, 24),
}


def regex_text(pattern: str, most: int = 8) -> Callable[..., Column]:
    """A generator of texts that match a regular expression, compiled once to columns: a sequence is a concatenation, a class a character of its pool, a repetition (at most `most` beyond the least) a
    transform of a sequence of numbers, an alternation a case. ValueError for what no such text can be made from (look-around, back references)."""
    import re

    try:
        tree = re._parser.parse(pattern.replace(r"\z", r"\Z"))
    except re.error as e:
        raise ValueError(f"not a regular expression: {pattern}") from e
    plain = "abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    kinds = {"CATEGORY_DIGIT": "0123456789", "CATEGORY_SPACE": " ", "CATEGORY_WORD": plain[:36] + "_", "CATEGORY_NOT_DIGIT": plain[:26], "CATEGORY_NOT_SPACE": plain[:36], "CATEGORY_NOT_WORD": "-"}

    def pool_of(items) -> str:
        pool, negate = "", False
        for op, arg in items:
            name = str(op)
            negate |= name == "NEGATE"
            if name == "LITERAL":
                pool += chr(arg)
            elif name == "RANGE":
                pool += "".join(map(chr, range(arg[0], min(arg[1], arg[0] + 255) + 1)))
            elif name == "CATEGORY":
                pool += kinds[str(arg)]
        pool = "".join(x for x in plain + "_-" if x not in pool) if negate else "".join(dict.fromkeys(pool))
        if not pool:
            raise ValueError(f"no character for a class of {pattern}")
        return pool

    count = 0

    def compiled(tree) -> Callable[..., Column]:
        """seed, row, path, more -> a text."""
        nonlocal count
        parts: list[Callable[..., Column]] = []
        for op, arg in tree:
            count += 1
            name, at = str(op), f"#r{count}"
            if name in ("LITERAL", "NOT_LITERAL", "ANY", "IN"):
                pool = {"LITERAL": lambda: chr(arg), "NOT_LITERAL": lambda: pool_of([("NEGATE", None), ("LITERAL", arg)]), "ANY": lambda: plain, "IN": lambda: pool_of(arg)}[name]()
                parts.append((lambda text: lambda *_: F.lit(text))(pool) if len(pool) == 1 else (lambda text, at: lambda s, r, p, *m: F.substr(F.lit(text), (below(len(text), s, r, p + at, *m) + 1).cast("int"), F.lit(1)))(pool, at))
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                lo, hi = arg[0], min(int(arg[1]), arg[0] + most)
                parts.append(_repeated(compiled(arg[2]), lo, hi, at))
            elif name == "BRANCH":
                parts.append(_chosen([compiled(x) for x in arg[1]], at))
            elif name == "SUBPATTERN":
                parts.append(compiled(arg[-1]))
            elif name != "AT":
                raise ValueError(f"{name} in {pattern}")
        return lambda s, r, p, *m: F.concat(F.lit(""), *[f(s, r, p, *m) for f in parts])

    return compiled(tree)


def _repeated(sub: Callable[..., Column], lo: int, hi: int, at: str) -> Callable[..., Column]:
    def text(s, r, p, *m) -> Column:
        n = (below(hi - lo + 1, s, r, p + at, *m) + lo).cast("int") if hi > lo else F.lit(lo)
        made = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: sub(s, r, p, *m, i)), "")
        return made if lo > 0 else F.when(n > 0, made).otherwise("")

    return text


def _chosen(options: list[Callable[..., Column]], at: str) -> Callable[..., Column]:
    def text(s, r, p, *m) -> Column:
        k = below(len(options), s, r, p + at, *m)
        return reduce(lambda out, i: F.when(k == i, options[i](s, r, p, *m)).otherwise(out), reversed(range(len(options) - 1)), options[-1](s, r, p, *m))

    return text


def custom_keys(pattern: str, seed: int | str, row: Column, path: str, *more: Column) -> Column:
    """A key of a pattern of one's own; 24 hexadecimal digits where the pattern is unreadable."""
    try:
        return regex_text(pattern)(seed, row, path, *more)
    except ValueError:
        return KEYS["CUSTOM"](seed, row, path, *more)


def custom_key_list(pattern: str, count: Column, seed: int | str, row: Column, path: str, *more: Column) -> Column:
    """An array of `count` different keys that match a regular expression, at any depth; 24 hexadecimal digits where the pattern is unreadable, or after its texts where it has too few."""
    plain = KEYS["CUSTOM"]
    span = lambda n: F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int"))
    try:
        make = regex_text(pattern)
        some = F.array_distinct(F.transform(span(count * 4), lambda i: make(seed, row, path, *more, i)))
    except ValueError:
        some = F.array().cast("array<string>")
    # Digits that are like one of the texts by chance would be repeated: the array of both is made distinct again.
    both = F.array_distinct(F.concat(some, F.transform(span(count + 1), lambda i: plain(seed, row, path + "#more", *more, i))))
    return F.slice(both, 1, F.greatest(count, F.lit(0)).cast("int"))


def keys(pattern: str, count: Column, seed: int | str, row: Column, path: str) -> Column:
    """An array of `count` different keys."""
    make = KEYS[pattern]
    made = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1)).cast("int")), lambda i: make(seed, row, path, i))
    return F.when(count > 0, made).otherwise(F.array().cast("array<string>"))


def key_valid(key: Column, pattern: str) -> Column:
    """Whether a key has the pattern's shape; CUSTOM keys are never tested."""
    return F.lit(True) if pattern == "CUSTOM" else key.rlike(KEY_PATTERNS[pattern])


def balanced(op: Callable, items: list[Column]) -> Column:
    """op over all items as a shallow tree: structs may have thousands of fields."""
    while len(items) > 1:
        items = [op(*items[i : i + 2]) if i + 1 < len(items) else items[i] for i in range(0, len(items), 2)]
    return items[0]


def ladder(weights: list[tuple[object, float]], u: Column) -> Column:
    """Inverse of a cumulative distribution: the first value at which u * total is under the running sum."""
    if not weights:
        raise ValueError("empty distribution")
    total, run, steps = sum(w for _, w in weights), 0, []
    for v, w in weights:
        run += w
        steps.append((run, v))
    return reduce(lambda out, s: F.when(u * total < s[0], F.lit(s[1])).otherwise(out), reversed(steps[:-1]), F.lit(steps[-1][1]))
