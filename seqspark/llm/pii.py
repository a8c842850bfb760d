"""Personal data replaced by keyed surrogates of the same type, script, gender and format. DataFrame functions only.

Found are e-mail addresses, IPv4 addresses, secrets (assigned tokens, keys, passwords and some well-known key formats), payment
cards (numbers whose check digit holds), phone and social security numbers, IBANs, and names after one or more titles: all the capitalised
words and initials that follow. A name found in a text is replaced wherever one of its words stands in that text, with or without a title. Each
match has one or more units (a name has one a word) in a canonical form: lower case, digits without separators. A unit's surrogate depends on
the key, its kind and its canonical form only, so every mention of one entity gets the same surrogate, in its own mention's separators and
letter case.

* Digits: a Feistel permutation of the numbers of that length, so different numbers stay different. A card keeps its first digit and
  its check digit holds again, a phone number with a plus sign keeps its first digit. IPv4: the same over 32 bits.
* Secrets, IBANs and e-mail addresses: letters for letters of the same script, digits for digits; hexadecimal stays so. Domains end in
  the reserved ``.example``.
* Names: syllables of the same script. In one text a word is a given name if it stands before another one of its name, else a family name.
  A given name follows the gender of the titles that it has in the text; none or both give a neutral one. Initials are shifted by the key.

Collisions are checked over all distinct units: where units share a surrogate, or a surrogate is itself a unit of
the corpus, all but one (or all) are drawn again with the next attempt, until none is left; if that does not end, an error says so. Where all short
forms may be taken, later attempts make addresses, secrets and names longer. Only those exceptions are joined to the
documents, by a digest of the text; the rest is computed where the text is, so no text is shuffled unless there are more exceptions than
Spark broadcasts.

The key is a secret: an argument, or the session's ``seqspark.pii.key``. There is none by default.

Edge cases: null stays null, a text without entities stays as it is; rows of equal text get equal results, whatever their ids; an empty table
gives an empty result; other columns pass through (``n_entities`` is replaced; ``_found``, ``_named``, ``_h`` and ``_attempts`` are for its own use).
"""

from __future__ import annotations

import hashlib
import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspark.llm.common import cut, discard

#: Titles by the gender of the given name that follows ("" for none).
TITLES = {"Mr": "m", "Mister": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f", "Dr": "", "Prof": ""}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NAME = r"(?:\p{Lu}['’]\p{Lu}\p{Ll}+|\p{Lu}\p{Ll}+(?:['’-]?\p{Lu}\p{Ll}+)*)"
_TITLE = rf"(?:{'|'.join(TITLES)})\.?"
_PARTICLE = r"(?:von|van|zu|de|der|den|di|da|del|la|le|el|al|bin|ben) "
_ASSIGNED = r"(?:(?i:api[_-]?key|access[_-]?key|secret(?:[_-]?key)?|auth[_-]?token|token|password|passwd|pwd)[\"']?\s{0,3}[=:]\s{0,3}[\"']?)"
#: Each pattern of the first group begins with a letter, each of the second with none.
PATTERNS = {
    "secret": _ASSIGNED + r"[A-Za-z0-9_\-+/=.]{8,}",
    "key": r"(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,})(?![A-Za-z0-9])",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "name": rf"{_TITLE} (?:{_TITLE} )*(?:\p{{Lu}}\. )*(?:{_PARTICLE}){{0,2}}{_NAME}(?: \p{{Lu}}\.(?= )| (?:{_PARTICLE}){{0,2}}{_NAME}){{0,4}}(?![\p{{L}}])",
    "ip": rf"(?<!\d\.)(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "card": r"(?<!\d\.)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?!\d|\.\d)",
    "ssn": r"(?<!\d-)\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}-\d{4}|(?<!\d[.-])\d{3}[-.]\d{3}[-.]\d{4}"
    + r"|(?<![\d$€£#] |\d[.,-])[2-9]\d{2} [2-9]\d{2} \d{4}|(?<![$€£#.,-])[2-9]\d{2}[2-9]\d{6})(?!\d|[.,-]\d)",
    "email": r"[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]+)+",
}
_LETTERED, _NUMBERED = ("secret", "key", "iban", "name"), ("ip", "card", "ssn", "phone")
#: An entity begins where no letter, digit or part of an address stands before; the character that it begins with decides what is tried.
ENTITY = (
    r"(?<![A-Za-z0-9_\p{L}])(?:(?=[A-Za-z])(?:" + "|".join(PATTERNS[k] for k in _LETTERED) + r")|(?=[\d+(])(?:" + "|".join(PATTERNS[k] for k in _NUMBERED)
    + r")|(?<![.%+-])(?:" + PATTERNS["email"] + "))"
)

#: In a text with names, each capitalised word may be one of them.
ENTITY_OR_WORD = ENTITY[:-1] + rf"|{_NAME}(?!\p{{L}}))"

#: The session's setting for the key; a key for tests and examples, which protects nothing.
KEY_SETTING, TEST_KEY = "seqspark.pii.key", "a key for tests"

#: Attempts after which a surrogate gets a character more.
GROW = 4

#: Letters that stand for a letter of each script.
SCRIPTS = {r"\p{IsCyrillic}": "абвгдежзиклмнопрстуфхцчшэюя", r"\p{IsGreek}": "αβγδεζηθικλμνξοπρστυφχψω"}
#: Syllables of names by script; the last entry is Latin.
SYLLABLES = {
    r"\p{IsCyrillic}": ("ба ве ги до жу зе ко ла ми но па ро са ту фи ша", "ова ина ева ая", "ов ин ев ич"),
    r"\p{IsGreek}": ("βα γε δι θο κα λε μι νο πα ρε σι το φα χε", "ια α η", "ος ης ας"),
    "": ("ba be di do fa ga he jo ka la le mi no pa ra re sa so ta ti va ve wi za", "a ia ina elle", "n r s t"),
}


def kind_of(match: Column, named: Column) -> Column:
    """The kind of a whole match; "none" for digits that only look like a card and for words that are no name of the text."""
    whole = lambda kind: match.rlike(rf"^(?:{PATTERNS[kind]})$")
    out = F.when(F.contains(match, F.lit("@")) & ~match.rlike(r"[=:]"), "email")
    for kind in ("secret", "key", "ip", "iban", "ssn"):
        out = out.when(whole(kind), kind)
    digits = _digits(match)
    valid = _check_digit(digits.substr(F.lit(1), F.length(digits) - 1)).cast("string") == F.right(digits, F.lit(1))
    out = out.when(whole("card"), F.when(valid, "card").otherwise("none")).when(whole("name"), "name")
    return out.when(match.rlike(rf"^{_NAME}$"), F.when(_name_kind(named, F.lower(match)).isNotNull(), "name").otherwise("none")).otherwise("phone")


def _secret_start(match: Column) -> Column:
    return F.length(F.regexp_extract(match, f"^{_ASSIGNED}", 0))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _let(value: Column, body) -> Column:
    """body of a value that is computed once. It keeps both the work and the plan small: a column that is used twice is there twice."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _is_name_word(word: Column) -> Column:
    return word.rlike(rf"^{_NAME}$") & ~word.isin(*TITLES)


def named_in(matches: Column) -> Column:
    """struct<m, f, given, family>: the words of the names with titles among a text's matches, in lower case. m and f: given names after a
    title of that gender."""
    genders = F.create_map(*[F.lit(x) for pair in TITLES.items() for x in pair])

    def parts(match: Column) -> Column:
        words = F.split(match, " ")
        titles = F.transform(words, lambda w: F.coalesce(genders[F.regexp_replace(w, r"\.$", "")], F.lit("")))
        return F.struct(F.array_max(titles).alias("gender"), F.transform(F.filter(words, _is_name_word), F.lower).alias("words"))

    names = F.transform(F.filter(matches, lambda m: m.rlike(rf"^{_TITLE} ")), parts)
    given = lambda of: F.array_distinct(F.flatten(F.transform(of, lambda x: F.slice(x["words"], 1, F.greatest(F.size(x["words"]) - 1, F.lit(0))))))
    family = F.array_distinct(F.transform(names, lambda x: F.element_at(x["words"], -1)))
    by = lambda g: given(F.filter(names, lambda x: x["gender"] == g))
    return F.struct(by("m").alias("m"), by("f").alias("f"), given(names).alias("given"), family.alias("family"))


def _name_kind(named: Column, word: Column) -> Column:
    """The kind of a lower-case word by a text's names, null for none of them."""
    has = lambda part: F.array_contains(named[part], word)
    kind = F.when(has("m") & has("f"), "given").when(has("m"), "givenm").when(has("f"), "givenf").when(has("given"), "given")
    return kind.when(has("family"), "family")


def unit_of(kind: Column, match: Column) -> Column:
    """struct<kind, canon> of a match other than a name: what it is looked up and checked by."""
    canon = (
        F.when(kind == "secret", F.lower(match.substr(_secret_start(match) + 1, F.length(match))))
        .when(kind.isin("email", "key", "ip"), F.lower(match))
        .when(kind == "iban", F.lower(F.regexp_replace(match, " ", "")))
        .otherwise(_digits(match))
    )
    own = F.when((kind == "phone") & match.startswith("+"), F.lit("phone+")).otherwise(kind)
    return F.struct(own.alias("kind"), canon.alias("canon"))


def units_in(matches: Column, named: Column) -> Column:
    """array<struct<kind, canon>>: the distinct units of a text."""
    with_kind = F.transform(matches, lambda m: F.struct(kind_of(m, named).alias("k"), m.alias("m")))
    others = F.transform(F.filter(with_kind, lambda x: ~x["k"].isin("name", "none")), lambda x: unit_of(x["k"], x["m"]))
    names = F.transform(F.array_union(named["given"], named["family"]), lambda w: F.struct(_name_kind(named, w).alias("kind"), w.alias("canon")))
    return F.array_distinct(F.concat(others, names))


def _number(digest: Column, start: int = 1) -> Column:
    return F.conv(F.substring(digest, start, 12), 16, 10).cast("long")


def _keyed(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *[p.cast("string") for p in parts]), 256)


def _feistel(key: str, kind: Column, attempt: Column, left: Column, right: Column, mod_left: Column, mod_right: Column) -> Column:
    """struct<a, b>: a permutation of the pairs below (mod_left, mod_right), six half rounds."""

    def half(s: Column, i: Column) -> Column:
        of = F.when(i % 2 == 0, s["b"]).otherwise(s["a"])
        f = _number(_keyed(key, kind, attempt, i, mod_left, mod_right, of))
        return F.struct(
            F.when(i % 2 == 0, F.pmod(s["a"] + F.pmod(f, mod_left), mod_left)).otherwise(s["a"]).alias("a"),
            F.when(i % 2 == 0, s["b"]).otherwise(F.pmod(s["b"] + F.pmod(f, mod_right), mod_right)).alias("b"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(5)), F.struct(left.cast("long").alias("a"), right.cast("long").alias("b")), half)


def _permuted_digits(key: str, kind: Column, attempt: Column, digits: Column) -> Column:
    """Another number of as many digits; of one digit, itself. At most 36 digits."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    power = lambda k: F.concat(F.lit("1"), F.repeat(F.lit("0"), k)).cast("long")
    pair = _feistel(key, kind, attempt, digits.substr(F.lit(1), half).cast("long"), digits.substr(half + 1, n).cast("long"), power(half), power(n - half))
    return F.when(n < 2, digits).otherwise(_let(pair, lambda p: F.concat(F.lpad(p["a"].cast("string"), half, "0"), F.lpad(p["b"].cast("string"), n - half, "0"))))


def _check_digit(body: Column) -> Column:
    """The Luhn check digit that makes body + digit valid."""
    n = F.length(body)
    d = lambda i: body.substr(i, F.lit(1)).cast("int")
    doubled = lambda x: F.when(x > 4, x * 2 - 9).otherwise(x * 2)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + F.when((n - i) % 2 == 0, doubled(d(i))).otherwise(d(i)))
    return F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10))


def _substituted(key: str, kind: Column, attempt: Column, text: Column) -> Column:
    """Letters for letters of the same script, digits for digits; the rest stays. Lower-case text."""
    hexadecimal = text.rlike(r"^[0-9a-f]{16,}$")
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / 32).cast("int")), lambda b: _keyed(key, kind, attempt, b, text))
    stream = F.array_join(blocks, "")

    def changed(stream: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            r = F.conv(stream.substr(i * 2 + 1, F.lit(2)), 16, 10).cast("int")
            pick = lambda alphabet: F.lit(alphabet).substr(r % len(alphabet) + 1, F.lit(1))
            out = F.when(c.rlike("[0-9]"), (r % 10).cast("string")).when(hexadecimal, pick("abcdef")).when(c.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz"))
            for script, alphabet in SCRIPTS.items():
                out = out.when(c.rlike(script), pick(alphabet))
            return out.when(c.rlike(r"\p{L}"), pick("abcdefghijklmnopqrstuvwxyz")).otherwise(c)

        return F.array_join(F.transform(F.split(text, ""), one), "")

    return _let(stream, changed)


def _name(key: str, kind: Column, attempt: Column, word: Column) -> Column:
    """A name of two or three syllables and an ending by gender, more syllables with each attempt."""

    def made(digest: Column) -> Column:
        def of(script: str) -> Column:
            syllables, female, male = (F.array(*[F.lit(x) for x in s.split()]) for s in SYLLABLES[script])
            at = lambda of, i: F.element_at(of, (F.pmod(_number(digest, i), F.size(of)) + 1).cast("int"))
            many = F.transform(F.sequence(F.lit(0), attempt + 1 + F.pmod(_number(digest, 40), F.lit(2)).cast("int")), lambda i: F.element_at(
                syllables, (F.pmod(F.conv(digest.substr(i * 4 + 1, F.lit(4)), 16, 10).cast("long"), F.size(syllables)) + 1).cast("int")))
            return F.concat(F.array_join(many, ""), F.when(kind == "givenf", at(female, 30)).otherwise(at(male, 30)))

        out = None
        for script in SYLLABLES:
            if script:
                out = F.when(word.rlike(script), of(script)) if out is None else out.when(word.rlike(script), of(script))
        return out.otherwise(of(""))

    return _let(_keyed(key, kind, attempt, word), made)


def _grown(kind: Column, canon: Column, attempt: Column) -> Column:
    """An address's local part or a secret with its last letter or digit once more for every ``GROW`` attempts."""
    end = F.locate("@", F.concat(canon, F.lit("@")))
    own = canon.substr(F.lit(1), end - 1)
    last = F.regexp_extract(own, r"([\p{L}0-9])[^\p{L}0-9]*$", 1)
    more = F.repeat(F.when(last == "", F.lit("x")).otherwise(last), F.floor(attempt / GROW).cast("int"))
    return F.when((attempt >= GROW) & kind.isin("email", "secret"), F.concat(own, more, canon.substr(end, F.length(canon)))).otherwise(canon)


def surrogate_of(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """The canonical form of a unit's surrogate, names left out."""
    n = F.length(canon)
    body, last = canon.substr(F.lit(1), n - 1), canon.substr(n, F.lit(1)).cast("int")
    # numbers: the digits in the middle are permuted; a card ends in a check digit
    keeps = kind.isin("card", "phone+")
    middle = F.when(kind == "card", body.substr(F.lit(2), n)).when(kind == "phone+", canon.substr(F.lit(2), n)).otherwise(canon)
    number = F.concat(F.when(keeps, canon.substr(F.lit(1), F.lit(1))).otherwise(F.lit("")), _permuted_digits(key, kind, attempt, middle))
    check = lambda b: F.pmod(_check_digit(b) + last - _check_digit(body), F.lit(10)).cast("string")
    number = _let(number, lambda b: F.when(kind == "card", F.concat(b, check(b))).otherwise(b))
    octets = lambda i: F.split_part(canon, F.lit("."), F.lit(i)).cast("long")
    side = F.lit(65536).cast("long")
    pair = _feistel(key, kind, attempt, octets(1) * 256 + octets(2), octets(3) * 256 + octets(4), side, side)
    ip = _let(pair, lambda p: F.concat_ws(".", F.floor(p["a"] / 256).cast("string"), (p["a"] % 256).cast("string"), F.floor(p["b"] / 256).cast("string"), (p["b"] % 256).cast("string")))
    # text: an IBAN keeps its country; an address's local part depends on all of it, its domain's surrogate on the domain alone
    changed = _substituted(key, kind, attempt, F.when(kind == "iban", canon.substr(F.lit(3), n)).otherwise(_grown(kind, canon, attempt)))
    domain = F.regexp_replace(F.split_part(canon, F.lit("@"), F.lit(2)), r"\.[^.]*$", "")
    address = lambda t: F.concat(F.split_part(t, F.lit("@"), F.lit(1)), F.lit("@"), _substituted(key, F.lit("domain"), F.lit(0), domain), F.lit(".example"))
    text = _let(changed, lambda t: F.when(kind == "email", address(t)).when(kind == "iban", F.concat(canon.substr(F.lit(1), F.lit(2)), t)).otherwise(t))
    return F.when(kind.isin("email", "secret", "key", "iban"), text).when(kind == "ip", ip).otherwise(number)


def any_surrogate(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """The same for units of every kind, names too."""
    return F.when(kind.startswith("given") | (kind == "family"), _name(key, kind, attempt, canon)).otherwise(surrogate_of(key, kind, canon, attempt))


def _filled(pattern: Column, mark: str, characters: Column) -> Column:
    """pattern with its characters of the class mark replaced, one after the other."""

    def step(s: Column, c: Column) -> Column:
        hit = c.rlike(mark)
        return F.struct(F.concat(s["out"], F.when(hit, characters.substr(s["k"] + 1, F.lit(1))).otherwise(c)).alias("out"), (s["k"] + hit.cast("int")).alias("k"))

    return F.aggregate(F.split(pattern, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("k")), step, lambda s: s["out"])


def _cased(like: Column, text: Column) -> Column:
    return F.when((like == F.upper(like)) & (like != F.lower(like)), F.upper(text)).otherwise(text)


def replacement(key: str, match: Column, named: Column, attempts: Column | None) -> Column:
    """A match in its surrogate form. named: the names of its text; attempts: map of kind and canonical form to the attempt, null for none."""

    def drawn(kind: Column, canon: Column) -> Column:
        n = F.lit(0) if attempts is None else F.coalesce(attempts[F.concat_ws(" ", kind, canon)], F.lit(0))
        return surrogate_of(key, kind, canon, n)

    shift = int(hashlib.sha256(f"{key}\x1finitial".encode()).hexdigest()[:8], 16) % 25 + 1

    def name(match: Column) -> Column:
        def one(word: Column) -> Column:
            kind, initial = _name_kind(named, F.lower(word)), word.rlike(r"^[A-Z]\.$")
            moved = F.concat(F.char((F.ascii(word) - 65 + shift) % 26 + 65), F.lit("."))
            capital = _let(_name_drawn(kind, F.lower(word)), lambda s: F.concat(F.upper(s.substr(F.lit(1), F.lit(1))), s.substr(F.lit(2), F.length(s))))
            return F.when(_is_name_word(word) & kind.isNotNull(), capital).when(initial, moved).otherwise(word)

        return F.array_join(F.transform(F.split(match, " "), one), " ")

    def _name_drawn(kind: Column, canon: Column) -> Column:
        n = F.lit(0) if attempts is None else F.coalesce(attempts[F.concat_ws(" ", kind, canon)], F.lit(0))
        return _name(key, kind, n, canon)

    def filled(kind: Column) -> Column:
        start = _secret_start(match)
        put = lambda value: (
            F.when(kind == "secret", F.concat(match.substr(F.lit(1), start), _cased(match.substr(start + 1, F.length(match)), value)))
            .when(kind == "iban", _filled(match, "[A-Za-z0-9]", F.upper(value)))
            .when(kind.isin("email", "ip"), _cased(match, value))
            .when(kind == "key", _filled_like(match, value))
            .otherwise(_filled(match, "[0-9]", value))
        )
        other = _let(unit_of(kind, match), lambda u: _let(drawn(u["kind"], u["canon"]), put))
        return F.when(kind == "none", match).when(kind == "name", name(match)).otherwise(other)

    return _let(kind_of(match, named), filled)


def _filled_like(match: Column, value: Column) -> Column:
    """value in the letter case of each of match's characters; a well-known prefix stays."""
    prefix = F.length(F.regexp_extract(match, r"^(?:AKIA|gh[pousr]_|sk-)", 0))

    def one(c: Column, i: Column) -> Column:
        v = value.substr(i + 1, F.lit(1))
        return F.when(i < prefix, c).when(c.rlike("[A-Z]"), F.upper(v)).otherwise(v)

    return F.array_join(F.transform(F.split(match, ""), one), "")


def _marked(docs: DataFrame) -> DataFrame:
    """docs with _found (the matches of a text) and _named (its names). Only a text with names is looked through once more, for their words."""
    rows = docs.withColumn("_found", F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0)))
    rows = rows.withColumn("_named", named_in(F.col("_found")))
    return rows.withColumn("_found", F.when(_has_names(), F.regexp_extract_all("text", F.lit(ENTITY_OR_WORD), F.lit(0))).otherwise(F.col("_found")))


def _has_names() -> Column:
    return F.size("_named.family") > 0


def exceptions(docs: DataFrame, key: str, rounds: int = 100) -> DataFrame:
    """(kind, canon, attempt) of the distinct units whose first surrogate collides, as a written table. Each round keeps one unit of those
    that share a surrogate; a surrogate that is a unit of the corpus is never kept. An error if some still collide after all rounds."""
    units = _marked(docs.select("text")).select(F.explode(units_in(F.col("_found"), F.col("_named"))).alias("u")).select("u.kind", "u.canon").distinct()
    first = cut(units.withColumn("attempt", F.lit(0)).withColumn("surrogate", any_surrogate(key, F.col("kind"), F.col("canon"), F.lit(0))))
    real = first.select("kind", F.col("canon").alias("surrogate"))
    now, settled = first, None
    for i in itertools.count(1):
        pool = now if settled is None else settled.unionByName(now)
        shared = pool.groupBy("kind", "surrogate").agg(F.count("*").alias("n"), F.min(F.struct("attempt", "canon")).alias("first")).where("n > 1")
        lost = now.join(shared, ["kind", "surrogate"]).where(F.struct("attempt", "canon") != F.col("first")).select(*now.columns)
        taken = now.join(real, ["kind", "surrogate"], "left_semi").select(*now.columns)
        lost = cut(lost.unionByName(taken).dropDuplicates(["kind", "canon"]))
        if lost.isEmpty():
            break
        if i > rounds:
            raise RuntimeError(f"surrogates still collide after {rounds} rounds")
        kept = now.join(lost.select("kind", "canon"), ["kind", "canon"], "left_anti")
        before, settled = settled, cut(kept if settled is None else settled.unionByName(kept))
        again = lost.select("kind", "canon").withColumn("attempt", F.lit(i))
        old, now = now, cut(again.withColumn("surrogate", any_surrogate(key, F.col("kind"), F.col("canon"), F.lit(i))))
        discard(before, lost, None if old is first else old)
    out = cut((now if settled is None else settled.unionByName(now)).select("kind", "canon", "attempt").where("attempt > 0"))
    discard(first, lost, settled, now)
    return out


def key_of(spark: SparkSession) -> str | None:
    return spark.conf.get(KEY_SETTING, None)


def pseudonymised(docs: DataFrame, key: str | None = None) -> DataFrame:
    """docs with surrogates in text, and n_entities."""
    key = key or key_of(docs.sparkSession)
    if not key:
        raise ValueError(f"surrogates need a secret key: an argument, or {KEY_SETTING} in the session")
    columns = [c for c in docs.columns if c != "n_entities"]
    bumped = exceptions(docs, key)
    rows, attempts = _marked(docs.select(*columns)), None
    if not bumped.isEmpty():
        met = _marked(docs.select("text")).select(F.xxhash64("text").alias("_h"), F.explode(units_in(F.col("_found"), F.col("_named"))).alias("u"))
        met = met.select("_h", "u.kind", "u.canon").join(bumped, ["kind", "canon"]).distinct()
        maps = met.groupBy("_h").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws(" ", "kind", "canon"), "attempt"))).alias("_attempts"))
        # written, so that Spark knows its size and broadcasts it where it is small
        rows = rows.withColumn("_h", F.xxhash64("text")).join(cut(maps), "_h", "left")
        attempts = F.col("_attempts")
    gaps = F.when(_has_names(), F.split("text", ENTITY_OR_WORD, -1)).otherwise(F.split("text", ENTITY, -1))
    new = F.transform(F.col("_found"), lambda m: replacement(key, m, F.col("_named"), attempts))
    text = F.array_join(F.flatten(F.zip_with(gaps, new, lambda g, m: F.array(g, F.coalesce(m, F.lit(""))))), "")
    n_entities = F.size(F.filter("_found", lambda m: kind_of(m, F.col("_named")) != "none"))
    rows = rows.withColumn("n_entities", F.coalesce(F.when(F.col("text").isNotNull(), n_entities), F.lit(0)))
    return rows.withColumn("text", F.when(F.size("_found") > 0, text).otherwise(F.col("text"))).select(*columns, "n_entities")
