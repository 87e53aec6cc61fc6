"""Keyed, type-consistent surrogates for personal data, in DataFrame functions alone.

Detection is one alternation of patterns; the text is split at its matches and put together again around their
surrogates.  A card number counts only with a valid check digit.  A name is found after a title; a text that has
introduced a name that way has it replaced wherever it stands, whole or by its family name alone.  A surrogate keeps the
entity's type and format: digits stay digits in their grouping, letters keep case and script, a card number keeps a
valid check digit, a given name is replaced by one of the same gender and script, a family name by one of its script.
It depends on a secret key, the type, the normalised value and an attempt number only, so one entity has one surrogate
in every document (coreference), and the family name of a person is the same with and without the given name.
Distinctness is checked over the whole corpus: the distinct entities are gathered in a dictionary; where two of them
share a surrogate, or a surrogate is itself an entity of the corpus, all but the first try again.  Names grow longer
with the attempts; of a format with too few values for its entities, what is left at the end is permuted within itself.
The documents that hold an entity get the dictionary's entries by joins; the others are never shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import column, forget, materialize, outward, table

# --- fixed values: titles, and detection patterns by type, in order of precedence ------------------------------------
MALE_TITLES = ["Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Г-н", "Κος"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Lady", "Frau", "Madame", "Mme", "Señora", "Sra", "Г-жа", "Κα"]
#: Titles of any gender: the given name decides.
OTHER_TITLES = ["Dr", "Doctor", "Doktor", "Prof", "Professor"]
_TITLE = "(?:" + "|".join(MALE_TITLES + FEMALE_TITLES + OTHER_TITLES) + r")\.? (?:(?:" + "|".join(OTHER_TITLES) + r")\.? )*"
_PARTICLES = r"(?:(?:de|da|di|du|del|della|la|le|van|von|der|den|zu|zur|bin|ibn|al) ){0,2}"
#: A name's word: letters in any case after a capital, with hyphens and apostrophes inside.
_WORD = r"\p{Lu}\p{L}*(?:['’\-]\p{L}+)*"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]+(?:\.[\p{L}\p{N}\-]+)*\.[\p{L}]{2,}",
    "secret": r"(?i:token|secret|password|passwd|api[_\-]?key|access[_\-]?key)[ \t]*[:=][ \t]*(?:[\"'][^\"'\n]{6,}[\"']|(?=[A-Za-z0-9_\-./+=]*[0-9])[A-Za-z0-9_\-./+=]{8,}(?<![.=]))",
    "key": r"(?<![\p{L}\p{N}_])(?:A(?:KIA|SIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_\-]{20,}|xox[abpr]-[A-Za-z0-9\-]{10,})(?![\p{L}\p{N}_])",
    "ip6": r"(?<![\p{L}\p{N}:.])(?=[0-9a-fA-F:]*[0-9])(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){1,6}(?::[0-9a-fA-F]{1,4}){1,6})(?![\p{L}\p{N}:])",
    "ip": r"(?<![\p{L}\p{N}.])(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}(?![\p{N}]|\.[\p{N}])",
    "hex_secret": r"(?<![\p{L}\p{N}])[0-9a-fA-F]{32,}+(?![\p{L}\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ssn": r"(?<![\p{L}\p{N}\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}\-])",
    "card": r"(?<![\p{L}\p{N}\-])[0-9](?:[ \-]?[0-9]){12,18}(?![\p{L}\p{N}])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{2,4}(?:[ .\-]?[0-9]{2,4}){1,4}|\([0-9]{3}\)[ ]?[0-9]{3}[ .\-][0-9]{4}|[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4}|(?=0(?:[ \-/]?[0-9]){8,12}(?![0-9]))0[0-9]{1,4}[ \-/][0-9]{3,8}(?:[ \-][0-9]{2,8}){0,3})(?![\p{L}\p{N}])",
    "name": rf"(?<![\p{{L}}]){_TITLE}{_PARTICLES}{_WORD}(?: {_PARTICLES}{_WORD}){{0,2}}",
}
NAMES = {
    ("latin", "m"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karim", "Leon", "Marco", "Noel", "Oscar", "Paul"],
    ("latin", "f"): ["Anna", "Berta", "Clara", "Diana", "Emma", "Fiona", "Greta", "Helen", "Irene", "Julia", "Karin", "Laura", "Maria", "Nora", "Olga", "Paula"],
    ("cyrillic", "m"): ["Алексей", "Борис", "Виктор", "Дмитрий", "Егор", "Игорь", "Кирилл", "Максим"],
    ("cyrillic", "f"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Ксения", "Мария"],
    ("greek", "m"): ["Ανδρέας", "Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος", "Σπύρος", "Χρήστος"],
    ("greek", "f"): ["Άννα", "Βασιλική", "Ελένη", "Ζωή", "Κατερίνα", "Μαρία", "Νίκη", "Σοφία"],
}
SYLLABLES = {
    "latin": ["ba", "de", "fi", "go", "lu", "ma", "ne", "ri", "so", "tu", "va", "ke", "pi", "no", "la", "re"],
    "cyrillic": ["ба", "ве", "ги", "до", "лу", "ма", "не", "ри", "со", "ту", "ва", "ке", "пи", "но", "ла", "ре"],
    "greek": ["βα", "δε", "φι", "γο", "λου", "μα", "νε", "ρι", "σο", "του", "πα", "κε", "πι", "νο", "λα", "ρε"],
}
# ---------------------------------------------------------------------------------------------------------------------
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
_SCRIPT_PATTERNS = {"cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}"}
#: A cheap test that every match passes: no backtracking over plain words.
_HINT = r"@|[0-9]|(?i:token|secret|passw|key|[a-f]{8})|" + _TITLE
#: What may stand before an address in its run without being part of it: dot leaders, form lines, bullets.
_LEADER = r"^[._%+\-]+"
MAX_ATTEMPTS = 12
_TITLED = "^" + _TITLE


def _digits(text: Column) -> Column:
    return F.transform(F.split(text, ""), lambda c: c.cast("int"))


def luhn_sum(digits: Column) -> Column:
    """Check sum of a digit string: every second digit from the right is doubled."""
    values = F.transform(F.reverse(_digits(digits)), lambda d, i: F.when(i % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def entity_type(value: Column) -> Column:
    """The first type whose pattern is the whole value; null for a number that only looks like a card's."""
    valid = {"card": F.pmod(luhn_sum(F.regexp_replace(value, r"[^0-9]", "")), F.lit(10)) == 0}
    return reduce(lambda rest, t: F.when(value.rlike(rf"^(?:{PATTERNS[t]})$") & valid.get(t, F.lit(True)), t).otherwise(rest), reversed(PATTERNS), F.lit(None).cast("string"))


def normal_form(kind: Column, value: Column) -> Column:
    """What makes two mentions the same entity: digits for numbers, lower case for addresses without what leads up to them, the bare quoted secret."""
    return (
        F.when((kind == "phone") & value.rlike(r"^\+[0-9]{1,3}[^0-9]"), F.concat_ws("-", F.regexp_extract(value, r"^\+([0-9]+)", 1), F.regexp_replace(F.regexp_replace(value, r"^\+[0-9]+", ""), r"[^0-9]", "")))
        .when(kind.isin("card", "phone", "ssn"), F.regexp_replace(value, r"[^0-9]", ""))
        .when(kind == "iban", F.replace(value, F.lit(" "), F.lit("")))
        .when(kind == "email", F.lower(F.regexp_replace(value, _LEADER, "")))
        .when((kind == "secret") & value.rlike(r"[\"']$"), F.regexp_extract(value, r"[\"'](.*)[\"']$", 1))
        .when(kind == "secret", F.regexp_extract(value, r"[:=][ \t]*(.*)$", 1))
        .when(kind == "ip6", F.lower(value))
        .otherwise(value)
    )


def _stream(seed: Column, i: int) -> Column:
    """The i-th block of a keyed stream: 64 hexadecimal digits."""
    return F.sha2(F.concat(seed, F.lit(f"#{i}")), 256)


def _shaped(value: Column, seed: Column) -> Column:
    """The value with every letter and digit replaced by one of its class, drawn from the keyed stream; all else stays.

    Cyrillic and Greek letters stay in their script, other letters become Latin ones of the same case.
    """
    stream = F.concat(*(_stream(seed, i) for i in range(4)))

    def draw(i, alphabet):
        at = F.conv(F.substring(stream, F.pmod(i * 3, F.lit(253)).cast("int") + 1, 3), 16, 10).cast("int")
        return F.substring(F.lit(alphabet), F.pmod(at, F.lit(len(alphabet))) + 1, 1)

    def shape(c, i):
        return (
            F.when(c.rlike(r"[0-9]"), draw(i, "0123456789"))
            .when(c.rlike(r"[a-z]"), draw(i, "abcdefghijklmnopqrstuvwxyz"))
            .when(c.rlike(r"[A-Z]"), draw(i, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
            .when(c.rlike(r"\p{IsCyrillic}"), F.when(c.rlike(r"\p{Lu}"), draw(i, "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ")).otherwise(draw(i, "абвгдежзиклмнопрстуфхцчшэюя")))
            .when(c.rlike(r"\p{IsGreek}"), F.when(c.rlike(r"\p{Lu}"), draw(i, "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")).otherwise(draw(i, "αβγδεζηθικλμνξοπρστυφχψω")))
            .when(c.rlike(r"\p{Lu}"), draw(i, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
            .when(c.rlike(r"[\p{L}\p{N}]"), draw(i, "abcdefghijklmnopqrstuvwxyz"))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(value, ""), shape), "")


def surrogate(kind: Column, norm: Column, attempt: int, key: str) -> Column:
    """The surrogate of an entity's normal form, in the same normal form (of a given name with its family name: a given name)."""
    seed = F.concat(F.lit(key), F.lit("|"), kind, F.lit("|"), norm, F.lit(f"|{attempt}"))
    stream = _stream(seed, 0)

    def number(i, width=4):
        return F.conv(F.substring(stream, i, width), 16, 10).cast("int")

    shaped = _shaped(norm, seed)
    # a valid check sum stays valid: the last digit is set so that the sum is a multiple of ten
    body = F.substr(shaped, F.lit(1), F.length(shaped) - 1)
    check = F.pmod(F.lit(10) - F.pmod(luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
    card = F.when(F.pmod(luhn_sum(norm), F.lit(10)) == 0, F.concat(body, check)).otherwise(shaped)
    # the country code of a telephone number stays; an address of the reserved networks 240 to 255 (of any, where they
    # are taken); a reserved mail domain
    phone = F.when(norm.contains("-"), F.concat(F.substring_index(norm, "-", 1), _shaped(F.substring_index(norm, "-", -1), seed))).otherwise(shaped)
    ip = F.concat_ws(".", (F.pmod(number(1), F.lit(16)) + 240 if attempt < 6 else F.pmod(number(1), F.lit(255)) + 1).cast("string"), *(F.pmod(number(i), F.lit(256)).cast("string") for i in (5, 9, 13)))
    # hexadecimal digits of any length, in the letter case of the value, or of each of its letters where it has both
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.length(norm) - 1) / 64).cast("int")), lambda b: F.sha2(F.concat(seed, F.lit("#"), b.cast("string")), 256))
    lower = F.substr(F.array_join(blocks, ""), F.lit(1), F.length(norm))
    mixed = F.array_join(F.zip_with(F.split(norm, ""), F.split(lower, ""), lambda c, h: F.when(c.rlike("[A-F]"), F.upper(h)).otherwise(h)), "")
    hexa = F.when(~norm.rlike("[A-F]"), lower).when(~norm.rlike("[a-f]"), F.upper(lower)).otherwise(mixed)
    # a network address of the longer kind: its digits and letters, in its own groups
    six = F.array_join(F.zip_with(F.split(norm, ""), F.split(F.sha2(F.concat(seed, F.lit("#6")), 256), ""), lambda c, h: F.when(c.rlike("[0-9a-f]"), h).otherwise(c)), "")
    local, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    mail = F.concat(_shaped(local, seed), F.lit("@"), _shaped(F.regexp_extract(domain, r"^(.*)\.[^.]*$", 1), F.concat(seed, F.lit("d"))), F.lit(".invalid"))
    # a given name of the same gender and script, joined with others in later attempts; a family name of syllables
    script = reduce(lambda rest, s: F.when(norm.rlike(_SCRIPT_PATTERNS[s]), s).otherwise(rest), _SCRIPT_PATTERNS, F.lit("latin"))
    pick = lambda i, values: F.get(F.array(*map(F.lit, values)), F.pmod(number(i), F.lit(len(values))))
    longer = attempt // 3
    given = reduce(lambda rest, k: F.when((script == k[0]) & (kind == f"given:{k[1]}"), F.concat_ws("-", *(pick(1 + 4 * i, NAMES[k]) for i in range(1 + longer)))).otherwise(rest), NAMES, F.lit(None).cast("string"))
    family = reduce(lambda rest, k: F.when(script == k, F.initcap(F.concat(*(pick(1 + 4 * i, SYLLABLES[k]) for i in range(4 + longer))))).otherwise(rest), SYLLABLES, F.lit(None).cast("string"))
    return (
        F.when(kind == "card", card).when(kind == "ip", ip).when(kind == "ip6", F.substr(six, F.lit(1), F.length(norm))).when(kind == "key", F.concat(F.substring(norm, 1, 4), F.substr(shaped, F.lit(5)))).when(kind == "phone", phone).when(kind.isin("secret", "hex_secret") & norm.rlike(r"^[0-9a-fA-F]{16,}$"), hexa).when(kind == "email", mail)
        .when(kind.startswith("given"), given).when(kind == "family", family).when(kind == "iban", F.concat(F.substring(norm, 1, 2), F.substr(shaped, F.lit(3)))).otherwise(shaped)
    )


def _keys(kind: Column, value: Column) -> Column:
    """The dictionary entries of a mention: one, or of a name the family's and, with a given name, the whole name's.

    The whole name carries its gender, which the title tells; without a title it may be either that the text has introduced.
    """
    titled = value.rlike(_TITLED)
    rest = F.initcap(F.regexp_replace(value, _TITLED, ""))
    title = F.regexp_extract(value, r"^([^ .]+)", 1)
    known = F.substring_index(rest, " ", 1)
    male = F.when(title.isin(*OTHER_TITLES), ~(known.isin(*(n for (_, g), own in NAMES.items() if g == "f" for n in own)) | known.rlike("[aаα]$"))).otherwise(title.isin(*MALE_TITLES))
    entry = lambda k, n: F.struct(F.lit(k).alias("kind"), n.alias("norm"))
    whole = lambda k, fits: F.when(rest.contains(" ") & fits, entry(k, rest))
    names = F.array(entry("family", F.substring_index(rest, " ", -1)), whole("given:m", ~titled | male), whole("given:f", ~titled | ~male))
    return F.when(kind == "name", F.array_compact(names)).otherwise(F.array(F.struct(kind.alias("kind"), normal_form(kind, value).alias("norm"))))


def _mention(kind: Column, value: Column, replaced: Column) -> Column:
    """The surrogate in the mention's own format: separators, brackets, quotes and letter case."""
    grouped = F.array_join(
        F.transform(F.split(value, ""), lambda c, i: F.when(c.rlike(r"[0-9A-Z]"), F.substring(replaced, F.length(F.regexp_replace(F.substring(value, F.lit(1), i + 1), r"[^0-9A-Z]", "")), F.lit(1))).otherwise(c)), ""
    )
    return (
        F.when(kind.isin("card", "phone", "ssn", "iban"), grouped)
        .when((kind == "secret") & value.rlike(r"[\"']$"), F.concat(F.regexp_extract(value, r"^([^\"']*[\"'])", 1), replaced, F.substring(value, -1, 1)))
        .when(kind == "secret", F.concat(F.regexp_extract(value, r"^([^:=]*[:=][ \t]*)", 1), replaced))
        .when((kind == "ip6") & value.rlike("[A-F]"), F.upper(replaced))
        .when(kind == "email", F.concat(F.regexp_extract(value, _LEADER, 0), replaced))
        .otherwise(replaced)
    )


def _domain(kind: Column, norm: Column) -> Column:
    """Among what surrogates must be distinct: the type; of given names, those of one family name."""
    return F.when(kind.startswith("given"), F.concat(F.lit("given|"), F.substring_index(norm, " ", -1))).otherwise(kind)


def _plain(kind: Column, norm: Column) -> Column:
    """The normal form as surrogates have it: a telephone number without what sets its country code apart, a given name alone."""
    return F.when(kind == "phone", F.replace(norm, F.lit("-"), F.lit(""))).when(kind.startswith("given"), F.substring_index(norm, " ", 1)).otherwise(norm)


def _swapped(pending: DataFrame, settled: DataFrame, key: str) -> DataFrame:
    """Surrogates for the entities that no attempt has placed: those of one format are permuted among themselves.

    None is given its own value, and no other entity has a value of theirs, since settled surrogates are no entities of
    the corpus.  Much of a format is only left where it is nearly exhausted, so a group is bounded by its values.
    One that is left alone takes the value of a settled entity of its format.
    """
    kind, norm = F.col("kind"), F.col("norm")
    shape = F.when(kind == "phone", F.concat(F.substring_index(norm, "-", 1), F.lit("-"), F.regexp_replace(F.substring_index(norm, "-", -1), "[0-9]", "9")))
    shape = shape.when(kind == "card", F.concat(F.length(norm), F.lit(":"), F.pmod(luhn_sum(norm), F.lit(10)) == 0)).otherwise(F.regexp_replace(F.regexp_replace(F.regexp_replace(norm, "[0-9]", "9"), r"\p{Lu}", "A"), r"\p{Ll}", "a"))
    shaped = lambda df: df.select("kind", "norm", _domain(kind, norm).alias("domain"), shape.alias("shape"))
    group = Window.partitionBy("domain", "shape").orderBy(F.sha2(F.concat(F.lit(key), "norm"), 256), "kind", "norm")
    after = F.coalesce(F.lead("plain").over(group), F.first("plain").over(group))
    rows = shaped(pending).withColumn("plain", _plain(kind, norm))
    rows = rows.withColumns({"next": after, "n": F.count(F.lit(1)).over(Window.partitionBy("domain", "shape"))})
    other = shaped(settled).withColumn("plain", _plain(kind, norm)).groupBy("domain", "shape").agg(F.min("plain").alias("other"))
    rows = rows.join(other, ["domain", "shape"], "left")
    return rows.select("kind", "norm", F.when(F.col("n") == 1, F.coalesce("other", "next")).otherwise(F.col("next")).alias("surrogate"))


def entity_dictionary(mentions: DataFrame, key: str) -> DataFrame:
    """(kind, norm, surrogate) of every distinct entity in ``mentions`` (kind, norm).

    Attempt by attempt, the entities whose surrogate is taken (by an entity of smaller order, by one that is settled, or
    by a real entity of the corpus) move on to the next attempt.  Each round is joins over narrow rows, and writes what
    it has settled; no two entities of a type share a surrogate.
    """
    real = materialize(mentions.select("kind", "norm").distinct(), "entities")
    names = real.select(_domain(F.col("kind"), F.col("norm")).alias("domain"), _plain(F.col("kind"), F.col("norm")).alias("surrogate")).distinct()
    pending, settled = real, None
    for attempt in range(MAX_ATTEMPTS):
        tried = materialize(pending.withColumn("surrogate", surrogate(F.col("kind"), F.col("norm"), attempt, key)), "tried")
        first = tried.groupBy(_domain(F.col("kind"), F.col("norm")).alias("domain"), "surrogate").agg(F.min(F.struct("kind", "norm")).alias("first"))
        first = first.join(names, ["domain", "surrogate"], "left_anti")
        if settled is not None:
            first = first.join(settled.select(_domain(F.col("kind"), F.col("norm")).alias("domain"), "surrogate"), ["domain", "surrogate"], "left_anti")
        won = materialize(first.select("first.kind", "first.norm", "surrogate"), "settled")
        settled = won if settled is None else settled.union(won)
        left = materialize(tried.select("kind", "norm").join(won, ["kind", "norm"], "left_anti"), "entities", [tried])
        if pending is not real:
            forget(pending)
        pending = left
        if pending.isEmpty():
            forget(real)
            return settled
    return settled.union(materialize(_swapped(pending, settled, key), "settled", [real, pending]))


def replace_pii(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``text`` replaced and ``n_entities`` (mentions replaced) added.

    Null and empty texts stay as they are with no entity; repeated rows get equal results; an empty table gives no row;
    other columns, whatever their nulls, stay as they are, and one that is called n_entities goes out as
    n_entities_input.  The secret ``key`` decides all surrogates.
    """
    names = outward(docs.columns, ["n_entities"])
    packed = docs.select(F.struct(*(column(n).alias(f"c{i}") for i, n in enumerate(docs.columns))).alias("_row"), column(text).alias("_text"))
    hit = F.coalesce(F.col("_text").rlike(_HINT) & F.col("_text").rlike(_ANY), F.lit(False))

    def restored(df, value, count):
        return df.select(*(value.alias(n) if own == text else F.col("_row")[f"c{i}"].alias(n) for i, (own, n) in enumerate(zip(docs.columns, names, strict=True))), count.cast("long").alias("n_entities"))

    clean = restored(packed.where(~hit), F.col("_text"), F.lit(0))
    # ``_key`` names a text by its content, so that repeated rows share one entry
    found = packed.where(hit).withColumn("_key", F.sha2("_text", 256)).withColumn("_first", F.regexp_extract_all("_text", F.lit(_ANY), F.lit(0)))
    # names that a title has introduced are looked for in the whole text, with and without the given name
    titled = F.transform(F.filter("_first", lambda v: v.rlike(_TITLED)), lambda v: F.regexp_replace(v, _TITLED, ""))
    found = found.withColumn("_names", F.array_union(titled, F.transform(titled, lambda v: F.substring_index(v, " ", -1))))
    longest_first = F.array_join(F.array_sort("_names", lambda a, b: F.length(b) - F.length(a)), "|")
    found = found.withColumn("_pattern", F.when(F.size("_names") == 0, F.lit(_ANY)).otherwise(F.concat(F.lit(_ANY + r"|(?<![\p{L}])(?:"), longest_first, F.lit(r")(?![\p{L}\p{N}])"))))
    found = found.withColumn("_values", F.when(F.size("_names") == 0, F.col("_first")).otherwise(F.regexp_extract_all("_text", F.col("_pattern"), F.lit(0))))
    typed = found.withColumn("_kinds", F.transform("_values", lambda v: F.coalesce(entity_type(v), F.when(F.array_contains("_names", v), F.lit("name")))))
    typed = typed.withColumn("_keys", F.zip_with("_kinds", "_values", lambda k, v: F.when(k.isNotNull(), _keys(k, v)))).drop("_first", "_names")
    typed = materialize(typed, "mentions")
    # an untitled name is one that a title has introduced in the same text: the titled mention stands in the dictionary
    entries_of = F.flatten(F.filter(F.zip_with("_keys", "_values", lambda k, v: F.when(F.size(k).isin(0, 1) | v.rlike(_TITLED), k)), lambda k: k.isNotNull()))
    each = materialize(typed.select("_key", F.explode(entries_of).alias("e")).select("_key", "e.kind", "e.norm").distinct(), "each")
    entries = entity_dictionary(each, key)
    per_text = each.join(entries, ["kind", "norm"]).groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("kind", "norm"), "surrogate"))).alias("_map"))
    joined = typed.join(materialize(per_text, "maps", [each]), "_key", "left")

    def replaced(z):
        of = lambda i: F.element_at(F.col("_map"), F.get(z["_keys"], F.lit(i)))
        title = F.regexp_extract(z["_values"], _TITLED, 0)
        own = F.regexp_replace(z["_values"], _TITLED, "")
        name = F.concat_ws(" ", F.coalesce(of(1), of(2)), of(0))
        name = F.concat(title, F.when((own == F.upper(own)) & (F.length(own) > 1), F.upper(name)).otherwise(name))
        return F.when(z["_kinds"].isNull(), z["_values"]).when(z["_kinds"] == "name", name).otherwise(_mention(z["_kinds"], z["_values"], of(0)))

    pieces = F.split("_text", F.col("_pattern"), -1)
    between = F.transform(F.arrays_zip("_values", "_kinds", "_keys"), replaced)
    whole = F.array_join(F.flatten(F.zip_with(pieces, between, lambda p, r: F.array(p, F.coalesce(r, F.lit(""))))), "")
    return clean.unionByName(restored(joined, whole, F.size(F.array_compact("_kinds"))))


#: The query's key; a deployment passes its own secret.
OP1_KEY = "rippleframe-demo-key"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the text with surrogates and n_entities of every document; null and empty texts stay, repeated rows repeat."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_pii(docs, OP1_KEY)
