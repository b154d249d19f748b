"""Personal data replaced by keyed surrogates of the same kind.

Entities are found by patterns: mail addresses, IPv4 addresses, phone numbers,
card and account numbers, IBANs, social security numbers, secrets (long hex and
access keys) and names behind a title. An entity's canonical form (letters
lower-cased, digits without separators) and the key give its surrogate:

* digits stay digits in the same layout, a ``+`` country code is kept, a number
  that passes the Luhn check still passes it;
* letters stay in their script and case; what follows the last dot of a mail
  address is kept; address octets stay between 1 and 254;
* a name keeps its title and its case. Latin names get a given name of the
  title's gender, other scripts keep the last letter, which carries gender.

One canonical form has one surrogate in all documents (coreference). The table
of different entities is checked: where two share a surrogate, or a surrogate
is some real entity, all but the least draw again with the next attempt until
none is left (distinctness). Only entities that had to draw again travel back
to their documents; all others are computed in the row.

DataFrame functions only. Defined results: null text stays null, text without
entities is unchanged byte for byte; repeated rows get equal results; an empty
table gives an empty result. Other columns are kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdikt.llm.rows import free
from verdikt.llm.store import stored

#: Rounds of drawing again; each leaves a vanishing share of the last.
ROUNDS = 60

#: Titles and the gender they tell.
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Mme", "Madame", "Mlle", "Frau", "Sra", "Señora", "Srta", "Signora", "г-жа", "Κυρία"],
    "m": ["Mr", "Mister", "Monsieur", "Herr", "Herrn", "Sr", "Señor", "Signor", "г-н", "Κύριος"],
    "n": ["Dr", "Prof", "Mx"],
}
#: Given names by gender.
GIVEN = {
    "f": "anna berta clara dora elena fiona greta hanna irene julia karla laura maria nora olga paula rita sofia thea vera".split(),
    "m": "adam boris carl david emil felix georg hugo ivan jonas karl leon martin nils oskar paul ralf simon theo viktor".split(),
    "n": "alex billie chris dana eden francis gray harper indigo jamie kim lee morgan noel parker quinn robin sasha taylor".split(),
}
#: Syllables of surrogate family names.
SYLLABLES = "bal ber bor dal den dor fal fen gar gol hal hen jor kal kel lan lor mal mer nor pal per ral ren sal ser tal tor val vin wal wen".split()


def _span(first: int, last: int) -> str:
    return "".join(map(chr, range(first, last + 1)))


#: Letters of each script: a pattern and the letters that surrogates use.
SCRIPTS = [
    (r"[a-z]", _span(0x61, 0x7A)),
    (r"\p{IsLatin}", "àáâäèéêëìíîïòóôöùúûüñç"),
    (r"\p{IsCyrillic}", _span(0x430, 0x44F)),
    (r"\p{IsGreek}", _span(0x3B1, 0x3C1) + _span(0x3C3, 0x3C9)),
    (r"\p{IsHebrew}", _span(0x5D0, 0x5EA)),
    (r"\p{IsArabic}", _span(0x628, 0x63A) + _span(0x641, 0x648)),
    (r"\p{IsDevanagari}", _span(0x915, 0x939)),
    (r"\p{IsHiragana}", _span(0x304B, 0x3062)),
    (r"\p{IsKatakana}", _span(0x30AB, 0x30C2)),
    (r"\p{IsHangul}", _span(0xAC00, 0xAC3F)),
    (r"\p{IsHan}", _span(0x4E00, 0x4E3F)),
]

_TITLE = {g: "(?:" + "|".join(names) + ")" for g, names in TITLES.items()}
_NAME = r"\p{Lu}[\p{L}'’-]*+"
#: Kinds in order of precedence, as patterns.
KINDS = {
    "email": r"(?<![._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)*\.\p{L}{2,}+",
    "ip": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)",
    "secret": r"(?<![\p{L}\p{N}])(?:[0-9a-fA-F]{32,}+|AKIA[0-9A-Z]{16}|(?:ghp|gho|ghs|sk|pk|xox[abp])[_-][0-9A-Za-z_-]{16,}+)(?![\p{L}\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,5}(?:[ .-]?\d{2,5}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<!\w)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\w)",
    "name": r"(?<![\p{L}\p{N}])(?:" + "|".join(_TITLE.values()) + r")\.? " + _NAME + "(?: " + _NAME + ")?",
}
#: Where a word starts, or the last entity ended.
_START = r"(?:\G|(?<![\p{L}\p{N}]))"
#: No entity starts inside a word: most places are passed over at a glance. Only
#: numbers also follow letters that are not ASCII, as in scripts without blanks.
ANY = (
    f"(?:{_START}|" + r"(?<![0-9A-Za-z])(?=[0-9+(]))(?=[\p{L}\p{N}._%+(-])(?:"
    + "|".join(_START + p if k == "email" else p for k, p in KINDS.items()) + ")"
)


#: What every secret without a digit holds.
_LETTERS_ONLY = "AKIA|(?:gh[pos]|sk|pk|xox[abp])[_-]|[a-fA-F]{32}"


def _hinted(text: Column) -> Column:
    """False only for texts without entities; plain searches, no pattern but
    those for a digit and, in texts without all else, for secrets of letters."""
    titles = [text.contains(t) for names in TITLES.values() for t in names]
    return text.rlike("[0-9]") | text.contains("@") | reduce(lambda a, b: a | b, titles) | text.rlike(_LETTERS_ONLY)


def entities(text: Column) -> Column:
    """All entities of a text from left to right, as they stand."""
    none = F.array().cast("array<string>")
    return F.when(_hinted(text), F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1))).otherwise(none)


def kind_of(entity: Column) -> Column:
    tests = [F.when(entity.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in KINDS.items()]
    return F.coalesce(*tests, F.lit("card"))


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``."""
    return F.transform(F.array(value), body)[0]


def canonical(entity: Column) -> Column:
    """Kind and canonical form, the same for all ways to write an entity."""
    title = F.regexp_extract(entity, r"^(\S+) ", 1)
    gender = reduce(lambda c, g: c.when(title.rlike(f"^{_TITLE[g]}\\.?$"), F.lit(g)), TITLES, F.when(F.lit(False), F.lit("")))
    name = F.concat(gender, F.lit(":"), F.lower(F.regexp_extract(entity, r"^\S+ (.*)$", 1)))
    # Numbers share one kind, so that layouts of one number stay together.
    return _let(
        kind_of(entity),
        lambda kind: F.when(kind.isin("phone", "ssn", "card"), F.concat(F.lit("number\x1f"), F.regexp_replace(entity, r"\D", "")))
        .when(kind == "iban", F.concat(F.lit("iban\x1f"), F.regexp_replace(entity, " ", "")))
        .when(kind == "email", F.concat(F.lit("email\x1f"), F.lower(entity)))
        .when(kind == "name", F.concat(F.lit("name\x1f"), name))
        .otherwise(F.concat(kind, F.lit("\x1f"), entity)),
    )


def _bytes(key: str, form: Column, attempt: Column) -> Column:
    """128 hex digits that only the key's holder can foretell; the attempt is
    part of them."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), form, attempt.cast("string")), 512)


def _byte(digest: Column, i: Column) -> Column:
    """The i-th number from 0 to 65535 drawn from a digest (from 0, in a circle
    of 125 places, for longer entities)."""
    at = F.pmod(i, F.lit(125)) + 1
    return F.conv(F.substring(digest, at, F.lit(4)), 16, 10).cast("int")


def _letter(char: Column, value: Column) -> Column:
    """A letter of the same script and case, a digit for a digit."""
    low = F.lower(char)
    made = F.when(char.rlike("^[0-9]$"), F.substring(F.lit("0123456789"), F.pmod(value, F.lit(10)) + 1, F.lit(1)))
    for pattern, letters in SCRIPTS:
        other = F.substring(F.lit(letters), F.pmod(value, F.lit(len(letters))) + 1, F.lit(1))
        made = made.when(low.rlike(f"^{pattern}$"), F.when(char != low, F.upper(other)).otherwise(other))
    made = made.when(char.rlike(r"^\p{N}$"), F.substring(F.lit("0123456789"), F.pmod(value, F.lit(10)) + 1, F.lit(1)))
    return made.when(char.rlike(r"^\p{L}$"), F.substring(F.lit(SCRIPTS[0][1]), F.pmod(value, F.lit(26)) + 1, F.lit(1))).otherwise(char)


def _spelled(text: Column, digest: Column) -> Column:
    """Each letter and digit replaced, everything else in its place."""
    return F.array_join(F.transform(F.split(text, ""), lambda c, i: _letter(c, _byte(digest, 2 * i))), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, modulo 10."""
    values = F.transform(
        F.reverse(F.split(digits, "")),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int") + 1)),
    )
    return F.aggregate(values, F.lit(0), lambda s, x: s + x) % 10


def _number(form: Column, digest: Column) -> Column:
    """Other digits; valid by Luhn if the number is and has 13 or more."""

    def checked(drawn: Column) -> Column:
        body = F.substring(drawn, F.lit(1), F.length(drawn) - 1)
        check = F.pmod(-_luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
        return F.when((F.length(form) >= 13) & (_luhn(form) == 0), F.concat(body, check)).otherwise(drawn)

    return _let(_spelled(form, digest), checked)


def _pick(words: list[str], value: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), F.pmod(value, F.lit(len(words))) + 1)


def _name(form: Column, digest: Column, attempt: Column) -> Column:
    gender, name = F.substring(form, 1, 1), F.regexp_extract(form, r"^.:(.*)$", 1)
    given = reduce(lambda c, g: c.when(gender == g, _pick(GIVEN[g], _byte(digest, F.lit(0)))), GIVEN, F.when(F.lit(False), F.lit("")))
    # Every attempt lengthens the family name, so there is always a free one.
    parts = F.transform(F.sequence(F.lit(1), F.least(F.lit(3) + F.floor(attempt / 4), F.lit(24)).cast("int")), lambda i: _pick(SYLLABLES, _byte(digest, 4 * i)))
    family = F.array_join(parts, "")
    latin = F.when(name.contains(" "), F.concat(given, F.lit(" "), family)).otherwise(family)
    words = F.transform(
        F.split(name, " "),
        lambda w: F.concat(_spelled(F.substring(w, F.lit(1), F.length(w) - 1), F.sha2(F.concat(digest, w), 512)), F.substring(w, -1, 1)),
    )
    return F.concat(gender, F.lit(":"), F.when(name.rlike(r"^[\p{IsLatin}\p{P} ’]+$"), latin).otherwise(F.array_join(words, " ")))


def _hex(body: Column, digest: Column) -> Column:
    def other(c: Column, i: Column) -> Column:
        at = F.pmod(_byte(digest, i), F.lit(16)) + 1
        return F.substring(F.when(c.rlike("[0-9a-f]"), F.lit("0123456789abcdef")).otherwise(F.lit("0123456789ABCDEF")), at, F.lit(1))

    return F.array_join(F.transform(F.split(body, ""), other), "")


def surrogate(form: Column, attempt: Column, key: str) -> Column:
    """The surrogate's canonical form, of the same kind."""

    def made(t: Column) -> Column:
        kind, body, digest = t["kind"], t["body"], t["digest"]
        octets = F.transform(F.split(body, r"\."), lambda o, i: (F.pmod(_byte(digest, 4 * i), F.lit(254)) + 1).cast("string"))
        # What is spelled anew, between a head and a tail that are kept.
        tail = F.when(kind == "email", F.regexp_extract(body, r"(\.[^.]*)$", 1)).otherwise("")
        head = F.when(kind == "email", F.lit("")).otherwise(F.regexp_extract(body, r"^(AKIA|[a-z]+[_-]|[A-Z]{2})", 1))
        middle = F.substring(body, F.length(head) + 1, F.length(body) - F.length(head) - F.length(tail))
        return (
            F.when(kind == "number", _number(body, digest))
            .when(kind == "ip", F.array_join(octets, "."))
            .when(kind == "name", _name(body, digest, attempt))
            .when((kind == "secret") & body.rlike(r"^[0-9a-fA-F]+$"), _hex(body, digest))
            .otherwise(F.concat(head, _spelled(middle, digest), tail))
        )

    parts = F.struct(
        F.regexp_extract(form, "^([a-z]+)\x1f", 1).alias("kind"),
        F.regexp_extract(form, "(?s)^[a-z]+\x1f(.*)$", 1).alias("body"),
        _bytes(key, form, attempt).alias("digest"),
    )
    return _let(parts, lambda t: F.concat(t["kind"], F.lit("\x1f"), made(t)))


def _laid_out(entity: Column, made: Column) -> Column:
    """A surrogate written the way the entity was."""
    kind = F.regexp_extract(made, "^([a-z]+)\x1f", 1)
    body = F.regexp_extract(made, "(?s)^[a-z]+\x1f(.*)$", 1)
    country = F.length(F.regexp_replace(F.regexp_extract(entity, r"^(\+\d{1,3})(?=[ .(-])", 1), r"\D", ""))
    chars = F.split(entity, "")
    filled = F.aggregate(
        chars,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("n")),
        lambda s, c: F.when(
            c.rlike(r"^[0-9A-Z]$"),
            F.struct(F.concat(s["out"], F.when(s["n"] < country, c).otherwise(F.substring(body, s["n"] + 1, F.lit(1)))).alias("out"), (s["n"] + 1).alias("n")),
        ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["n"].alias("n"))),
        lambda s: s["out"],
    )
    title = F.regexp_extract(entity, r"^(\S+ )", 1)
    rest = F.regexp_extract(entity, r"^\S+ (.*)$", 1)
    person = F.regexp_extract(body, r"^.:(.*)$", 1)
    person = F.when((rest == F.upper(rest)) & (F.length(rest) > 2), F.upper(person)).otherwise(F.initcap(person))
    cased = F.array_join(F.zip_with(chars, F.split(body, ""), lambda e, b: F.when(e != F.lower(e), F.upper(b)).otherwise(b)), "")
    return (
        F.when(kind.isin("number", "iban"), filled).when(kind == "name", F.concat(title, person)).when(kind == "email", cased).otherwise(body)
    )


def _distinct(found: DataFrame, key: str) -> DataFrame:
    """``form, attempt`` of each different entity, so that no two surrogates
    are equal and none is an entity."""
    table = stored(found.select("form").distinct().withColumns({"attempt": F.lit(0), "made": surrogate(F.col("form"), F.lit(0), key)}), "entities")
    real = table.select(F.col("form").alias("made")).distinct()
    for _ in range(ROUNDS):
        # The one longest settled keeps a shared surrogate.
        shared = Window.partitionBy("made").orderBy(F.col("attempt"), "form")
        again = table.withColumn("_n", F.row_number().over(shared)).where("_n > 1").select("form")
        again = stored(again.unionByName(table.join(real, "made", "left_semi").select("form")).distinct(), "again")
        if again.isEmpty():
            return table
        marked = table.join(again.withColumn("_again", F.lit(True)), "form", "left")
        attempt = F.col("attempt") + F.coalesce(F.col("_again").cast("int"), F.lit(0))
        table = stored(marked.select("form", attempt.alias("attempt")).withColumn("made", surrogate(F.col("form"), F.col("attempt"), key)), "entities")
    raise RuntimeError("surrogates still collide; the entities leave too little room")


def replaced(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with surrogates in its text, and ``n_entities``."""
    text, x = F.col(text_col), free(docs)
    seen, tries, mark = f"{x}found", f"{x}again", f"{x}mark"
    rows = docs.withColumn(seen, entities(text))
    forms = rows.where(F.size(seen) > 0).select(F.explode(seen).alias("entity")).select(canonical(F.col("entity")).alias("form"))
    again = stored(_distinct(forms, key).where("attempt > 0").select("form", "attempt"), "again")
    if again.isEmpty():
        rows = rows.withColumn(tries, F.lit(None).cast("map<string,int>"))
    else:
        # Texts that hold such an entity get its attempt by the text's hash.
        rows = rows.withColumn(mark, F.when(F.size(seen) > 0, F.xxhash64(text)))
        held = rows.where(F.size(seen) > 0).select(mark, F.explode(seen).alias("entity"))
        held = held.select(mark, canonical(F.col("entity")).alias("form")).distinct().join(again, "form")
        held = held.groupBy(mark).agg(F.map_from_entries(F.collect_list(F.struct("form", "attempt"))).alias(tries))
        rows = rows.join(held, mark, "left").drop(mark)

    def made(entity: Column) -> Column:
        def laid(form: Column) -> Column:
            attempt = F.coalesce(F.element_at(F.col(tries), form), F.lit(0))
            return _let(surrogate(form, attempt, key), lambda other: _laid_out(entity, other))

        return _let(canonical(entity), laid)

    gaps = F.split(text, ANY, -1)
    pieces = F.zip_with(gaps, F.transform(seen, made), lambda g, s: F.concat(g, F.coalesce(s, F.lit(""))))
    whole = F.when(F.size(seen) > 0, F.array_join(pieces, "")).otherwise(text)
    counted = F.when(text.isNull(), F.lit(0)).otherwise(F.size(seen))
    return rows.withColumn(text_col, whole).drop("n_entities").withColumn("n_entities", counted).drop(seen, tries)
