"""Operator 10: personal data replaced by keyed surrogates, in DataFrame functions only.

Detected: e-mail addresses, IPv4 addresses, phone numbers, payment cards, IBANs, US social security numbers, secrets (values
of any length assigned to a password, token or key, access-key ids) and names of persons. Names are learned, for each document, from
the one to three capitalised words after an honorific (TITLES: civil and academic ones, English, German, French, Spanish, Russian);
then every mention of these words in the document is replaced, with or without the honorific, as written or in capitals. A person never
named with an honorific isn't found, and initials ("H.") stay.

Each distinct entity (type and canonical form) gets one surrogate for the whole corpus, drawn from SHA-256 of key, type, attempt and
entity. Given and family names are entities of their own, so "Hugo Bern", "Mr. Bern" and "Bern" stay one person; the last word after an
honorific is the family name. Surrogates keep the type, the length (but of names and IP addresses), the
punctuation and the case letter by letter; cards and IBANs pass
their check digits where the original does; given names keep gender (that of most honorifics they stand with, else told by the ending)
and script, family names script. Entities whose surrogate is another one's, or equals an entity of the corpus, draw again until all are
distinct, the smallest entity keeping its draw; names grow by a syllable with each draw, other types by a character from the twelfth
draw on, so no format can run out.

Defined results: null text stays null with no entities; empty text stays empty; null doc_id stays null; repeated rows are treated alike;
other columns pass through, but for one named entities, which is replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch, skew

OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
TITLES = {
    "m": "Mr|Mister|Sir|Herr|Monsieur|Señor|Signor|Господин|господин|г-н",
    "f": "Mrs|Ms|Miss|Madam|Frau|Madame|Mme|Señora|Señorita|Signora|Госпожа|госпожа|г-жа",
    "": "Dr|Doctor|Prof|Professor|Доктор|доктор|Профессор|профессор",
}
TITLE = rf"(?:{'|'.join(TITLES.values())})\.? "
WORD = r"\p{Lu}(?:\.|[\p{L}'’-]{1,30})"
PHRASE = rf"(?<!\p{{L}})(?:{TITLE}){{1,2}}{WORD}(?: {WORD}){{0,2}}"
#: Quick to look for: no person stands in a text without it.
TITLED = f"[{''.join(sorted({t[0] for g in TITLES.values() for t in g.split('|')}))}](?:{'|'.join(sorted({t[1:] for g in TITLES.values() for t in g.split('|')}))})\\.? \\p{{Lu}}"
NAMES = {
    ("m", "latin"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karim", "Louis", "Marco", "Nils", "Oscar", "Pablo"],
    ("f", "latin"): ["Alma", "Bella", "Clara", "Diana", "Elena", "Flora", "Greta", "Helga", "Irena", "Julia", "Karina", "Laura", "Maria", "Nadia", "Olga", "Paula"],
    ("m", "cyrillic"): ["Иван", "Олег", "Пётр", "Антон"],
    ("f", "cyrillic"): ["Анна", "Ольга", "Нина", "Вера"],
}
#: Consonants, vowels, endings of male and female given names and of family names.
SOUNDS = {"latin": ("bdfgklmnprstvz", "aeiou", "n", "na", "r"), "cyrillic": ("бвгдзклмнпрст", "аеиоу", "н", "на", "в")}
KEYS = r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)"
ASSIGNED = rf"{KEYS} {{0,3}}[=:] {{0,3}}[\"']?"
#: In order: the first type that matches a place wins. Secrets are found with what introduces them, which stays.
PATTERNS = {
    "secret": rf"(?<![A-Za-z]){ASSIGNED}[A-Za-z0-9+/_.-]{{5,}}[A-Za-z0-9]={{0,2}}|(?<![A-Za-z0-9])AKIA[0-9A-Z]{{16}}(?![A-Za-z0-9])",
    "email": r"[\p{L}0-9][\p{L}0-9._%+-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,62})\.){1,6}[A-Za-z]{2,24}",
    "ipv4": rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![\d-])(?:(?:\d{4}[ -]?){3}\d{4}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5})(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\dA-Za-z+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\dA-Za-z])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _gate(text: Column) -> Column:
    """Whether the text may hold an entity at all; cheap, for most texts hold none."""
    assigned = text.rlike("[=:]") & text.rlike("(?i:pass|pwd|secret|token|key)")
    return F.coalesce(F.contains(text, F.lit("@")) | text.rlike("[0-9]") | F.contains(text, F.lit("AKIA")) | assigned | text.rlike(TITLED), F.lit(False))


def _kind(found: Column) -> Column:
    """The type of a match, told by its own form; null for a name."""
    whole = {
        "secret": rf"^(?:{ASSIGNED}|AKIA[0-9A-Z]{{16}}$)", "email": "@", "ipv4": rf"^(?:{OCTET}\.){{3}}{OCTET}$", "iban": r"^[A-Z]{2}\d{2}[ A-Z0-9]{8,}$",
        "card": r"^(?:(?:\d{4}[ -]?){3}\d{4}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5})$", "ssn": r"^\d{3}-\d{2}-\d{4}$", "phone": r"^[+(\d][\d ().+-]*$",
    }
    case = None
    for kind, pattern in whole.items():
        case = F.when(found.rlike(pattern), kind) if case is None else case.when(found.rlike(pattern), kind)
    return case


def _lead(kind: Column, found: Column) -> Column:
    """What introduces a secret within the match."""
    return F.when(kind == "secret", F.regexp_extract(found, rf"^(?:{ASSIGNED})", 0)).otherwise("")


#: Russian family names of women: those of men and "а".
FEMALE_FAMILY = r"(ов|ев|ёв|ин)а$"


def _canonical(kind: Column, found: Column) -> Column:
    found = F.substr(found, F.length(_lead(kind, found)) + 1)
    return (
        F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(found, r"\D", "")).when(kind == "iban", F.replace(found, F.lit(" "), F.lit("")))
        .when(kind == "family", F.regexp_replace(F.lower(found), FEMALE_FAMILY, "$1")).when(kind.isin("email", "given"), F.lower(found)).otherwise(found)
    )


def _hex(key: str, kind: Column, entity: Column, attempt: Column, block: int) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, attempt.cast("string"), F.lit(str(block)), entity), 256)


def _letters(stream: Column, like: Column) -> Column:
    """`like` with each letter and digit replaced by one of its own class, drawn from the hexadecimal stream."""
    def one(c: Column, i: Column) -> Column:
        v = F.conv(F.substring(stream, (i % 124) + 1, F.lit(3)), 16, 10).cast("int")
        return (
            F.when(c.rlike("[0-9]"), F.substring(F.lit("0123456789"), v % 10 + 1, F.lit(1)))
            .when(c.rlike("[a-z]"), F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), v % 26 + 1, F.lit(1)))
            .when(c.rlike("[A-Z]"), F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), v % 26 + 1, F.lit(1)))
            .when(c.rlike(r"\p{L}"), F.substring(F.lit("áéíóúñüöäç"), v % 10 + 1, F.lit(1)))
            .otherwise(c)
        )
    return F.array_join(F.transform(F.split(like, ""), one), "")


def _number(stream: Column, at: Column, digits: int = 2) -> Column:
    return F.conv(F.substring(stream, at, F.lit(digits)), 16, 10).cast("int")


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10 of a string of digits."""
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) + 1 - i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return (total + F.when(d > 9, d - 9).otherwise(d)) % 10
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def _mod97(code: Column) -> Column:
    """The remainder of an account number, moved round and read with A = 10, ..., Z = 35."""
    moved = F.concat(F.substr(code, F.lit(5)), F.substring(code, 1, 4))
    def add(total: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (total * 10 + c.cast("int")) % 97).otherwise((total * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), add)


def _name(stream: Column, attempt: Column, script: str, ending: int, list_: list[str] | None) -> Column:
    """A name of three syllables and one more for each attempt; the first attempt of a given name takes it from the list."""
    consonants, vowels, *endings = SOUNDS[script]
    def syllable(i: Column) -> Column:
        return F.concat(*(F.substring(F.lit(x), _number(stream, 1 + 4 * i + 2 * k) % len(x) + 1, F.lit(1)) for k, x in enumerate((consonants, vowels))))
    drawn = F.initcap(F.concat(F.array_join(F.transform(F.sequence(F.lit(0), F.least(attempt, F.lit(28)) + 2), syllable), ""), F.lit(endings[ending])))
    return drawn if list_ is None else F.when(attempt == 0, F.get(F.array(*map(F.lit, list_)), _number(stream, F.lit(1), 4) % len(list_))).otherwise(drawn)


def surrogate(key: str, kind: Column, entity: Column, gender: Column, attempt: Column) -> Column:
    """The surrogate of a canonical entity. Written for `attempt` 0, 1, ...; each gives another draw."""
    stream = F.concat(_hex(key, kind, entity, attempt, 0), _hex(key, kind, entity, attempt, 1))
    octet = lambda i: (_number(stream, F.lit(1 + 4 * i), 4) % 254 + 1).cast("string")
    more = _letters(F.reverse(stream), F.repeat(F.lit("0"), F.greatest(attempt - 11, F.lit(0))))
    top = F.regexp_extract(entity, r"(@.*)(\.[A-Za-z]+)$", 2)
    local, domain = F.substring_index(entity, "@", 1), F.regexp_replace(F.substring_index(entity, "@", -1), r"\.[A-Za-z]+$", "")
    email = F.concat(_letters(stream, F.concat(local, F.lit("@"), domain)), more, top)
    hexes = F.substring(F.repeat(stream, F.floor(F.length(entity) / 128).cast("int") + 1), F.lit(1), F.length(entity))
    secret = F.concat(F.when(entity.rlike("^[0-9a-f]+$"), hexes).when(entity.rlike("^AKIA"), F.concat(F.lit("AKIA"), _letters(stream, F.substr(entity, F.lit(5))))).otherwise(_letters(stream, entity)), more)
    country = F.substring(entity, 1, 2)
    account = F.concat(_letters(stream, F.substr(entity, F.lit(5))), more)
    right = 98 - _mod97(F.concat(country, F.lit("00"), account))
    wrong = (right - 1 + _number(stream, F.lit(60)) % 96) % 97 + 2
    iban = F.concat(country, F.lpad(F.when(_mod97(entity) == 1, right).otherwise(wrong).cast("string"), 2, "0"), account)
    # the first digit (country, issuer) is kept; the last of a card is its check digit, right or wrong as the original's
    phone = F.concat(F.substring(entity, 1, 1), _letters(stream, F.substr(entity, F.lit(2))), more)
    body = F.concat(F.substring(entity, 1, 1), _letters(stream, F.substring(entity, F.lit(2), F.length(entity) - 2)), more)
    check = (10 - _luhn(F.concat(body, F.lit("0")))) % 10
    card = F.concat(body, F.when(_luhn(entity) == 0, check).otherwise((check + 1 + _number(stream, F.lit(100)) % 9) % 10).cast("string"))
    cyrillic = entity.rlike(r"\p{IsCyrillic}")
    name = lambda script: F.when(kind == "family", _name(stream, attempt, script, 2, None)).when(gender == "f", _name(stream, attempt, script, 1, NAMES["f", script])).otherwise(_name(stream, attempt, script, 0, NAMES["m", script]))
    return (
        F.when(kind == "ipv4", F.concat_ws(".", *map(octet, range(4)))).when(kind == "email", email).when(kind == "secret", secret)
        .when(kind == "iban", iban).when(kind == "phone", phone).when(kind == "card", card).when(kind == "ssn", F.concat(_letters(stream, entity), more))
        .when(cyrillic, name("cyrillic")).otherwise(name("latin"))
    )


def _render(kind: Column, found: Column, new: Column) -> Column:
    """The surrogate in the format of this occurrence: its punctuation, its case."""
    glued = lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))
    slots = F.array_join(F.zip_with(F.split(found, r"\d"), F.split(new, ""), glued), "")
    spaced = F.array_join(F.zip_with(F.split(found, "[^ ]"), F.split(new, ""), glued), "")
    cased = F.array_join(F.zip_with(F.split(found, ""), F.split(new, ""), lambda a, b: F.when(F.coalesce(a != F.lower(a), F.lit(False)), F.upper(b)).otherwise(F.coalesce(b, F.lit("")))), "")
    whole = F.concat(new, F.when((kind == "family") & F.lower(found).rlike(FEMALE_FAMILY), "а").otherwise(""))
    return (
        F.when(kind.isin("phone", "card", "ssn"), slots).when((kind == "iban") & F.contains(found, F.lit(" ")), spaced)
        .when(kind == "email", cased).when(kind.isin("given", "family"), F.when((found == F.upper(found)) & (F.length(found) > 1), F.upper(whole)).otherwise(whole))
        .otherwise(F.concat(_lead(kind, found), new))
    )


def _persons(text: Column) -> Column:
    """struct<words, family, given, male, female> of a text: the names to look for, as written, and their lower-case forms by role."""
    strings = "array<string>"
    def parts(phrase: Column) -> Column:
        title = F.regexp_extract(phrase, rf"^(?:{TITLE}){{1,2}}", 0)
        words = F.split(F.substr(phrase, F.length(title) + 1), " ")
        gender = F.when(title.rlike(rf"(?:^| )(?:{TITLES['f']})\.? "), "f").when(title.rlike(rf"(?:^| )(?:{TITLES['m']})\.? "), "m").otherwise("")
        return F.struct(words.alias("w"), gender.alias("g"))
    found = F.transform(F.regexp_extract_all(text, F.lit(PHRASE), F.lit(0)), parts)
    plain = lambda words: F.filter(words, lambda w: ~F.endswith(w, F.lit(".")))
    low = lambda words: F.array_distinct(F.transform(words, F.lower))
    many = F.filter(found, lambda p: F.size(p["w"]) > 1)
    of = lambda ps, take: F.coalesce(F.flatten(F.transform(ps, lambda p: plain(take(p["w"])))), F.array().cast(strings))
    last, heads, every = (lambda w: F.slice(w, F.size(w), F.lit(1))), (lambda w: F.slice(w, F.lit(1), F.size(w) - 1)), (lambda w: w)
    first_names, family = low(of(many, heads)), low(of(many, last))
    alone = low(of(F.filter(found, lambda p: F.size(p["w"]) == 1), every))
    family = F.array_union(family, F.array_except(alone, F.array_except(first_names, family)))
    with_gender = lambda g: low(of(F.filter(found, lambda p: p["g"] == g), every))
    words = F.array_distinct(F.flatten(F.transform(of(found, every), lambda w: F.array(w, F.upper(w), F.initcap(w)))))
    return F.struct(words.alias("words"), family.alias("family"), F.array_except(first_names, family).alias("given"), with_gender("m").alias("male"), with_gender("f").alias("female"))


def _pattern(words: Column) -> Column:
    """The expression that finds a document's entities: that of all types, and its own names, longest first."""
    longest = F.transform(F.sort_array(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda x: x["w"])
    return F.concat(F.lit(ANY + r"|(?<![\p{L}])(?:"), F.array_join(longest, "|"), F.lit(r")(?![\p{L}])"))


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with __words (the document's names, null if none) and __found: array<struct<found, kind, entity, gender>> of all entities in order."""
    t = F.col(text)
    df = docs.withColumn("__who", F.when(t.rlike(TITLED), _persons(t))).withColumn("__words", F.when(F.size("__who.words") > 0, F.col("__who.words")))
    df = df.withColumn("__raw", F.when(F.col("__words").isNotNull(), F.regexp_extract_all(t, _pattern(F.col("__words")), F.lit(0))).otherwise(F.regexp_extract_all(t, F.lit(ANY), F.lit(0))))
    def one(m: Column) -> Column:
        kind = F.coalesce(_kind(m), F.when(F.array_contains("__who.family", F.lower(m)), "family").otherwise("given"))
        own = lambda c: F.coalesce(F.array_contains(c, F.lower(m)), F.lit(False))
        gender = F.when(kind != "given", 0).otherwise(own("__who.female").cast("int") - own("__who.male").cast("int"))
        return F.struct(m.alias("found"), kind.alias("kind"), _canonical(kind, m).alias("entity"), gender.alias("gender"))
    return df.withColumn("__found", F.transform("__raw", one)).drop("__raw", "__who")


def mapping(entities: DataFrame, key: str, rounds: int = 60) -> DataFrame:
    """One row for each distinct (kind, entity) of entities (kind, entity, gender: above 0 female, below male): its surrogate, all distinct
    and none an entity of the corpus itself."""
    spark = entities.sparkSession
    domain = F.when(F.col("kind").isin("given", "family"), "name").otherwise(F.col("kind")).alias("domain")
    known = entities.groupBy("kind", "entity").agg(F.sum("gender").alias("g"))
    # without an honorific to tell, names in -a count as female
    female = (F.col("g") > 0) | ((F.col("g") == 0) & F.col("entity").rlike("[aаяñ]$"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    todo = scratch.saved(known.select("kind", "entity", domain, F.when(female, "f").otherwise("m").alias("gender")), "entities")
    form = F.when(F.col("domain") == "name", F.initcap("entity")).otherwise(F.col("entity"))
    taken = todo.select("domain", form.alias("new")).distinct()
    done: DataFrame | None = None
    for attempt in range(rounds):
        # few bytes but much work: as many tasks as there are partitions, not as few as the bytes would fill
        drawn = todo.repartition(parts, "entity").withColumn("new", surrogate(key, F.col("kind"), F.col("entity"), F.col("gender"), F.lit(attempt)))
        order = Window.partitionBy("domain", "new").orderBy("entity", "kind")
        drawn = drawn.join(taken.withColumn("real", F.lit(True)), ["domain", "new"], "left").withColumn("clash", F.coalesce("real", F.lit(False)) | (F.row_number().over(order) > 1))
        drawn = scratch.saved(drawn.select("kind", "entity", "domain", "gender", "new", "clash"), "drawn")
        placed = drawn.where("not clash").select("kind", "entity", "new")
        # written together each time, so that the plan doesn't grow with the rounds
        last = drawn.where("clash").isEmpty()
        done = placed if done is None else scratch.saved(done.unionByName(placed), "placed")
        if last:
            return done
        taken = scratch.saved(taken.unionByName(drawn.where("not clash").select("domain", "new")), "taken")
        todo = drawn.where("clash").drop("clash", "new")
    raise RuntimeError(f"surrogates still clash after {rounds} draws ({spark.sparkContext.appName})")


def apply(docs: DataFrame, key: str = "surrogate-key-1", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with surrogates in `text`, and entities: array<struct<kind, surrogate>> in order of appearance (empty if none).

    Texts without a sign of an entity pass through; only the others are shuffled.
    """
    columns = [c for c in docs.columns if c != "entities"]
    none = F.array().cast("array<struct<kind:string,surrogate:string>>")
    kept = docs.select(*columns)
    given = kept.where(_gate(F.col(text)))
    found = detect(given.select(F.col(doc_id).alias("__id"), F.xxhash64(text).alias("__hash"), F.col(text).alias("__text")), "__text")
    # outer, and filtered behind: else the optimizer infers a filter that detects all over again
    rows = found.select("__id", "__hash", "__words", F.posexplode_outer("__found").alias("pos", "x")).where("pos is not null").select("__id", "__hash", "__words", "pos", "x.*")
    rows = scratch.saved(rows.dropDuplicates(["__id", "__hash", "pos"]), "occurrences")
    named = mapping(rows.select("kind", "entity", "gender"), key)
    placed = skew.lookup(rows, named, ["kind", "entity"], F.struct("__id", "pos"))
    placed = placed.withColumn("shown", _render(F.col("kind"), F.col("found"), F.col("new")))
    per_doc = placed.groupBy("__id", F.col("__hash").alias("__other")).agg(F.sort_array(F.collect_list(F.struct("pos", "kind", "shown"))).alias("__new"), F.first("__words", True).alias("__words"))
    rest = given.withColumn("__same", F.xxhash64(text))
    joined = rest.join(per_doc, rest[doc_id].eqNullSafe(per_doc["__id"]) & (rest["__same"] == per_doc["__other"]), "left").drop("__id", "__same", "__other")
    gaps = F.when(F.col("__words").isNotNull(), F.split(F.col(text), _pattern(F.col("__words")), -1)).otherwise(F.split(F.col(text), ANY, -1))
    new = F.array_join(F.zip_with(gaps, F.transform("__new", lambda x: x["shown"]), lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")
    changed = joined.withColumn(text, F.when(F.col("__new").isNotNull(), new).otherwise(F.col(text))).withColumn(
        "entities", F.coalesce(F.transform("__new", lambda x: F.struct(x["kind"].alias("kind"), x["shown"].alias("surrogate"))), none)
    )
    return kept.where(~_gate(F.col(text))).withColumn("entities", none).unionByName(changed.select(*columns, "entities"))
