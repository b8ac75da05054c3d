"""Personal data replaced by keyed surrogates, in DataFrame functions only.

Entities are found by one pattern and told apart by shape.  Their canonical form (digits of numbers, lower case of addresses and names)
decides the surrogate, so every mention of an entity in any document and format gets the same one.  A surrogate is a keyed hash in the shape of
its type: digits for digits, letters for letters in the same case, addresses in valid ranges, card numbers with the same Luhn remainder,
names of the same gender and script.  Given and family names are entities of their own, so "Mr. John Smith", "Mr. Smith" and "Mrs. Smith" share the surrogate of the
family, and a document that names somebody with a title has the same name replaced where it stands without one.  A telephone number is the same with and without
the country's 1.  Surrogates are checked over the whole corpus: one that another entity of its type has (all names are one type), or that is itself an entity found in any case of
letters, is drawn again with the next attempt, until all are distinct.  Names, addresses and secrets grow with every attempt, numbers with every twelfth, so free values never run out,
and nothing of an original is ever put out.

Cases: of equal surrogates the entity that comes first in the order of kind and form keeps it (ties); a null text stays null, an empty one empty; texts without entities pass unchanged and are not shuffled; repeated rows get equal texts;
very long texts are searched whole; an empty table gives an empty result; extra columns of any name are kept by `redact`.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noticeworks.llm import common

#: The setting that holds the secret key of surrogates.  Without it, anyone who reads this file can test guesses of an original: set it for data that is given away.
KEY_SETTING, KEY = "spark.noticeworks.surrogates.key", "noticeworks-surrogates-1"
#: Attempts of one length of numbers; after them they grow.  All surrogates grow up to what a digest can fill.
ATTEMPTS, MOST_GROWTH = 12, 24
# Shapes of entities, and titles that come before names, by gender.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
IP = r"\b(?<!\d\.)(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}\b(?!\.\d)"
# Eight groups, or fewer around one pair of colons; with a digit, so that words next to colons are none.
IPV6 = (
    r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
    r"|(?=[A-Fa-f:]{0,36}[0-9])(?=[0-9A-Fa-f:]{2,39}(?![\w:]))(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![\w:])"
)
CARD = r"\b\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}\b|\b3[47]\d{2}[ -]?\d{6}[ -]?\d{5}\b"
SSN = r"(?<![\w.+/-])\d{3}-\d{2}-\d{4}(?![\w-]|\.\d)"
IBAN = r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"
# A plus sign and 7 to 15 digits; an area code in brackets; or one without, as 3-3-4 digits or after a zero unless it is a date.
MARKED_PHONE = r"\+\d(?:[ ./()-]{0,2}\d){6,14}(?!\d)|\(\d{2,5}\)[ ./-]{0,2}\d(?:[ ./-]?\d){4,9}(?![ ./-]?\d)"
PLAIN_PHONE = (
    r"(?<![\w.+/-])(?:1[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}(?![\w-]|\.\d)"
    r"|(?<![\w.+/-])(?!\d{1,2}[./-]\d{1,2}[./-]\d{2,4}(?![./-]?\d))0[1-9](?:[ ./-]?\d){5,13}(?![\w/-]|\.\d)"
)
PHONE = f"{MARKED_PHONE}|{PLAIN_PHONE}"
# The value of a keyword of any case: the whole run from four characters on, without the marks that end a sentence or a list.
SECRET = (
    r"\bAKIA[0-9A-Z]{16}\b|(?<=[=:\s\"'])(?=[A-Za-z0-9_/+-][A-Za-z0-9_/+!#-&*.:=?@\\^`|~-]{2,256}[A-Za-z0-9_/+-])(?<=(?<![A-Za-z0-9])(?i:token|password|passwd|secret|api[_-]{0,1}key)[\"']{0,1}\s{0,2}[=:]\s{0,2}[\"']{0,1})"
    r"[A-Za-z0-9_/+-]++(?:[!#-&*.:=?@\\^`|~]++[A-Za-z0-9_/+-]++)*+={0,2}"
)
FEMALE_TITLES = r"Mrs\.|Ms\.|Mme|Madame|Frau|Señora|Sra\.|Г-жа|Госпожа"
MALE_TITLES = r"Mr\.|Monsieur|Herr|Señor|Sr\.|Г-н|Господин"
NEUTRAL_TITLES = r"Dr\.|Prof\.|Professor|Docteur|Доктор|Профессор"
TITLES = rf"(?:(?:{FEMALE_TITLES}|{MALE_TITLES}|{NEUTRAL_TITLES}) )(?:(?:{NEUTRAL_TITLES}) ){{0,3}}+"
NAME = rf"(?=[MFSHDPГДП]){TITLES}\p{{Lu}}[\p{{L}}\p{{M}}'’-]++(?: \p{{Lu}}[\p{{L}}\p{{M}}'’-]++)?"
# All but numbers with a mark begin where no letter or digit stands before; to ask that first spares the rest inside words.
ANY = rf"(?<![A-Za-z0-9])(?:{'|'.join((EMAIL, SECRET, IP, IPV6, CARD, IBAN, SSN, PLAIN_PHONE, NAME))})|{MARKED_PHONE}"
# A word that may be a name without a title; looked at only in documents that name somebody with one.
BARE = r"(?<![\p{L}\p{M}\p{N}'’-])\p{Lu}[\p{L}\p{M}'’-]++"
ANY_OR_BARE = f"{ANY}|{BARE}"
# Endings of given names by gender and script, and syllables of names by script.
ENDINGS = {
    ("f", "latin"): "a ia ina ella".split(),
    ("m", "latin"): "o us an er".split(),
    ("f", "cyrillic"): "а ия ина".split(),
    ("m", "cyrillic"): "ан ей ор ис".split(),
    ("n", "latin"): "y e is el".split(),
    ("n", "cyrillic"): "и е ю".split(),
}
SYLLABLES = {"latin": "ba be bo da de do fa fe ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta te to va ve vo".split(), "cyrillic": "ба бе бо ва ве во да де до ка ко ла ле ло ма ме мо на не но ра ре ро са се со та".split()}
#: Syllables of a name before it grows.
GIVEN_SYLLABLES, FAMILY_SYLLABLES = 2, 3
PARTS = "array<struct<kind:string,canon:string>>"


def kind_of(found: Column) -> Column:
    """The type of an entity by its shape."""
    kind = F.when(found.rlike(rf"^(?:{EMAIL})$"), "email").when(found.rlike(rf"^(?:{IP})$"), "ip").when(found.rlike(rf"^(?:{IPV6})$"), "ipv6").when(found.rlike(rf"^(?:{CARD})$"), "card")
    kind = kind.when(found.rlike(rf"^(?:{SSN})$"), "ssn").when(found.rlike(rf"^(?:{PHONE})$"), "phone")
    kind = kind.when(found.rlike(rf"^(?:{FEMALE_TITLES}) "), "name_f").when(found.rlike(rf"^(?:{MALE_TITLES}) "), "name_m").when(found.rlike(rf"^{TITLES}"), "name_n")
    return kind.when(found.rlike(rf"^(?:{IBAN})$") & ~found.rlike("^[A-Z]{2}[0-9]{2}[0-9A-Z ]*[a-z]"), "iban").otherwise("secret")


def canonical(kind: Column, found: Column) -> Column:
    """The form that tells entities of a kind apart, names excepted."""
    digits = F.regexp_replace(found, r"\D", "")
    phone = F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(digits)
    return F.when(kind.isin("card", "ssn"), digits).when(kind == "phone", phone).when(kind.isin("email", "ipv6"), F.lower(found)).when(kind == "iban", F.replace(found, F.lit(" "), F.lit(""))).otherwise(found)


def parts_of(kind: Column, found: Column) -> Column:
    """The entities of a mention: given and family name of a name with a title, else one.  Digits in one run are a card's only if their check digit is right."""
    names = F.split(F.lower(F.regexp_replace(found, rf"^{TITLES}", "")), " ")
    given = F.concat(F.lit("given_"), F.substring(kind, 6, 1))
    last = F.size(names)
    named = F.transform(names, lambda n, i: F.struct(F.when(i == last - 1, "family").otherwise(given).alias("kind"), n.alias("canon")))
    no_card = (kind == "card") & found.rlike("^[0-9]+$") & (luhn(found) != 0)
    return F.when(kind.startswith("name"), named).when(no_card, F.array().cast(PARTS)).otherwise(F.array(F.struct(kind.alias("kind"), canonical(kind, found).alias("canon")))).cast(PARTS)


def _number(digest: Column, at: int, of: int) -> Column:
    """A number below `of` from four hexadecimal digits of a digest."""
    return (F.conv(F.substring(digest, 1 + 4 * at, 4), 16, 10).cast("int") % of).cast("int")


def luhn(digits: Column) -> Column:
    """Luhn sum modulo 10 of a string of digits."""
    values = F.transform(F.reverse(F.split(digits, "")), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10


def mod97(value: Column) -> Column:
    """The remainder by 97 of digits and capital letters, letters as numbers from 10."""
    code = lambda c: F.ascii(c)
    return F.aggregate(F.split(value, ""), F.lit(0), lambda a, c: F.when(code(c) < 65, (a * 10 + code(c) - 48) % 97).otherwise((a * 100 + code(c) - 55) % 97))


def shaped(value: Column, digest: Column, keep: Column) -> Column:
    """Every digit and letter after the first `keep` characters replaced by one of its class; hexadecimal strings stay hexadecimal."""
    is_hex = value.rlike(r"^[0-9a-f:]+$")

    def turn(c: Column, i: Column) -> Column:
        draw = F.conv(F.substring(digest, (i * 2) % 126 + 1, 2), 16, 10).cast("int")
        letter = lambda first, n: F.char(F.lit(ord(first)) + (draw % n))
        new = F.when(c.rlike("[0-9]"), letter("0", 10)).when(c.rlike("[a-f]") & is_hex, letter("a", 6)).when(c.rlike("[a-z]"), letter("a", 26)).when(c.rlike("[A-Z]"), letter("A", 26))
        return F.when(i < keep, c).otherwise(F.coalesce(new, c))

    return F.array_join(F.transform(F.split(value, ""), turn), "")


def surrogate(kind: Column, canon: Column, attempt: int, key: str) -> Column:
    """The keyed surrogate of a canonical entity at an attempt."""
    growth, slow = min(attempt, MOST_GROWTH), min(attempt // ATTEMPTS, MOST_GROWTH)
    digest = F.sha2(F.concat_ws("\x01", F.lit(key), kind, canon, F.lit(str(attempt))), 512)
    address = F.concat_ws(".", *[(_number(digest, k, 254) + 1).cast("string") for k in range(4)])
    if slow:
        address = F.concat(F.lit("fd00"), *[x for k in range(7) for x in (F.lit(":"), F.substring(digest, 1 + 4 * k, 4))])
    address6 = address if slow else shaped(canon, digest, F.lit(0))
    letters = F.translate(F.substring(digest, 49, growth), "0123456789", "ghijklmnop")
    digits = F.translate(F.substring(digest, 49, slow), "abcdef", "258147")
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    email = F.concat(shaped(local, digest, F.lit(0)), letters, F.lit("@"), shaped(F.regexp_replace(domain, r"\.[^.]+$", ""), F.reverse(digest), F.lit(0)), F.regexp_extract(domain, r"\.[^.]+$", 0))
    body = F.concat(F.substr(shaped(canon, digest, F.when(F.length(canon) == 15, 2).otherwise(1)), F.lit(1), F.length(canon) - 1), digits)
    card = F.concat(body, ((luhn(canon) - luhn(F.concat(body, F.lit("0"))) + 10) % 10).cast("string"))
    phone = F.concat(shaped(canon, digest, F.greatest(F.length(canon) - 10, F.lit(0))), digits)
    account = shaped(F.substr(canon, F.lit(5)), digest, F.lit(0))
    country = F.substring(canon, 1, 2)
    iban = F.concat(country, F.lpad((98 - mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0"), account)
    # A secret of marks alone has nothing to draw, so from the first growth on marks are letters too.
    secret = F.concat(shaped(F.regexp_replace(canon, r"[^A-Za-z0-9]", "x") if growth else canon, digest, F.when(canon.startswith("AKIA"), 4).otherwise(0)), letters)
    latin = ~canon.rlike(r"\p{IsCyrillic}")

    def name(syllables: int, gender: str | None = None) -> Column:
        def of(writing: str) -> Column:
            part = F.array(*map(F.lit, SYLLABLES[writing]))
            said = [F.element_at(part, _number(digest, k, len(SYLLABLES[writing])) + 1) for k in range(1, 1 + min(syllables + growth, MOST_GROWTH))]
            if gender:
                # The last syllable gives way to an ending: its consonant stays.
                said[-1] = F.concat(F.substring(said[-1], 1, 1), F.element_at(F.array(*map(F.lit, ENDINGS[gender, writing])), _number(digest, 0, len(ENDINGS[gender, writing])) + 1))
            return F.initcap(F.concat(*said))

        return F.when(latin, of("latin")).otherwise(of("cyrillic"))

    chosen = F.when(kind == "email", email).when(kind == "ip", address).when(kind == "ipv6", address6).when(kind == "card", card).when(kind.isin("phone", "ssn"), phone).when(kind == "iban", iban)
    chosen = chosen.when(kind == "given_f", name(GIVEN_SYLLABLES, "f")).when(kind == "given_m", name(GIVEN_SYLLABLES, "m")).when(kind == "given_n", name(GIVEN_SYLLABLES, "n"))
    return chosen.when(kind == "family", name(FAMILY_SYLLABLES)).otherwise(secret)


def rendered(kind: Column, found: Column, new: Column) -> Column:
    """Surrogates (an array, one for each part) in the format of the mention: punctuation of numbers, case of addresses, title and case of names."""
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))
    one = F.element_at(new, 1)
    digits = F.regexp_replace(found, r"\D", "")
    # What the canonical form leaves out (a country's 1) stays.
    number = F.when(kind == "phone", F.concat(F.when((F.length(digits) == 11) & digits.startswith("1"), "1").otherwise(""), one)).otherwise(one)

    def put(slots: str) -> Column:
        def step(acc: Column, c: Column) -> Column:
            slot = c.rlike(slots)
            return F.struct((acc["at"] + slot.cast("int")).alias("at"), F.concat(acc["out"], F.when(slot, F.substr(number, acc["at"], F.lit(1))).otherwise(c)).alias("out"))

        return F.aggregate(F.split(found, ""), start, step, lambda acc: F.concat(acc["out"], F.substr(number, acc["at"])))

    cased = F.array_join(F.transform(F.split(found, ""), lambda c, i: F.when(c.rlike("[A-Z]"), F.upper(F.substr(one, i + 1, F.lit(1)))).otherwise(F.substr(one, i + 1, F.lit(1)))), "")
    cased = F.when(F.length(one) == F.length(found), cased).otherwise(one)
    title = F.regexp_extract(found, rf"^{TITLES}", 0)
    bare = F.when((F.length(found) > 1) & (F.upper(found) == found), F.upper(one)).otherwise(one)
    shown = F.when(kind.isin("card", "phone", "ssn"), put("[0-9]")).when(kind == "iban", put("[0-9A-Z]")).when(kind.isin("email", "ipv6"), cased)
    return shown.when(kind.startswith("name"), F.concat(title, F.array_join(new, " "))).when(kind == "bare", bare).otherwise(one)


def group_of(kind: Column) -> Column:
    """Kinds whose surrogates are kept apart together: all names are one."""
    return F.when(kind.isin("given_f", "given_m", "given_n", "family"), "name").otherwise(kind)


def surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """kind, canon, surrogate of distinct entities (kind, canon): distinct within a group of kinds, and none that is an entity itself."""
    pending, done = entities, None
    group = group_of(F.col("kind")).alias("group")
    real = entities.select(group, F.lower("canon").alias("form"), F.lit(True).alias("is_real")).distinct()
    for attempt in count():
        drawn = pending.withColumn("surrogate", surrogate(F.col("kind"), F.col("canon"), attempt, key)).withColumn("group", group).withColumn("form", F.lower("surrogate"))
        drawn = drawn.join(real, ["group", "form"], "left")
        if done is not None:
            drawn = drawn.join(done.select(group, F.lower("surrogate").alias("form"), F.lit(True).alias("taken")), ["group", "form"], "left")
        else:
            drawn = drawn.withColumn("taken", F.lit(None).cast("boolean"))
        first = F.row_number().over(W.partitionBy("group", "form").orderBy("kind", "canon"))
        drawn = common.written(drawn.withColumn("ok", (first == 1) & F.col("is_real").isNull() & F.col("taken").isNull()), "surrogates")
        fine = drawn.where("ok").select("kind", "canon", "surrogate")
        done = fine if done is None else done.unionByName(fine)
        pending = drawn.where("not ok").select("kind", "canon")
        if not pending.take(1):
            return done


def mentions(value: Column) -> Column:
    """found, kind and parts of every entity of a text in order.  Where a name has a title, every capitalised word is a mention, without parts if it is none of the names."""

    def read(pattern: str, with_bare: bool) -> Column:
        found = F.regexp_extract_all(value, F.lit(f"({pattern})"), F.lit(1))
        if with_bare:
            # The second group is empty unless the mention is a bare word.
            bare = F.regexp_extract_all(value, F.lit(f"({ANY}|({BARE}))"), F.lit(2))
            found = F.arrays_zip(found.alias("found"), bare.alias("bare"))
            typed = F.transform(found, lambda f: F.struct(f["found"].alias("found"), F.when(f["bare"] != "", "bare").otherwise(kind_of(f["found"])).alias("kind")))
        else:
            typed = F.transform(found, lambda f: F.struct(f.alias("found"), kind_of(f).alias("kind")))
        return F.transform(typed, lambda f: F.struct(f["found"].alias("found"), f["kind"].alias("kind"), F.when(f["kind"] == "bare", F.array().cast(PARTS)).otherwise(parts_of(f["kind"], f["found"])).alias("parts")))

    return F.when(value.rlike(NAME), read(ANY_OR_BARE, True)).otherwise(read(ANY, False))


def redact(docs: DataFrame, text: str = "text", key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """docs with surrogates in the text column, with the same columns; and (row, n_entities) of every document."""
    key = key or docs.sparkSession.conf.get(KEY_SETTING, KEY)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    value = F.col("row").getField(text)
    held = F.coalesce(value.rlike(ANY), F.lit(False))
    clean = row.where(~held).select("row", F.lit(0).alias("n_entities"), value.alias("new"))
    # Equal texts have equal entities, so the text's hashes name a document's set of them.
    marked = row.where(held).select("row", mentions(value).alias("found"), F.sha2(value, 256).alias("name"))
    named = F.array_distinct(F.flatten(F.transform(F.filter("found", lambda f: f["kind"].startswith("name")), lambda f: f["parts"])))
    known = F.col("known")
    bare = lambda f: F.slice(F.filter(known, lambda p: p["canon"] == F.lower(f["found"])), 1, 1)
    resolved = F.transform("found", lambda f: F.struct(f["found"].alias("found"), f["kind"].alias("kind"), F.when(f["kind"] == "bare", bare(f)).otherwise(f["parts"]).alias("parts")))
    # The family comes first, so a word that is both somebody's given and another's family name reads as a family name.
    marked = marked.withColumn("known", F.array_sort(named, lambda x, y: F.when(x["kind"] < y["kind"], -1).when(x["kind"] > y["kind"], 1).otherwise(0)))
    seen = common.written(marked.select("row", "name", resolved.alias("found")), "marked")
    marked = seen.where(F.size(F.flatten("found.parts")) > 0)
    # What has an entity's shape only, as a number without a right check digit, stays.
    clean = clean.unionByName(seen.where(F.size(F.flatten("found.parts")) == 0).select("row", F.lit(0).alias("n_entities"), value.alias("new")))
    sets = marked.select("name", F.explode(F.flatten("found.parts")).alias("p")).select("name", "p.kind", "p.canon").distinct()
    sets = common.written(sets, "entity-sets")
    entities = common.written(sets.select("kind", "canon").distinct(), "entities")
    table, n = surrogates(entities, key), entities.count()
    with_new = sets.join(F.broadcast(table), ["kind", "canon"]) if n <= common.BROADCAST_ROWS else common.join_hot(sets, table, ["kind", "canon"])
    per_text = with_new.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\x01", "kind", "canon"), "surrogate"))).alias("map"))
    joined = common.join_hot(marked, per_text, ["name"])
    of = lambda f: F.transform(f["parts"], lambda p: F.element_at(F.col("map"), F.concat_ws("\x01", p["kind"], p["canon"])))
    new = F.transform("found", lambda f: F.when(F.size(f["parts"]) == 0, f["found"]).otherwise(rendered(f["kind"], f["found"], of(f))))
    gaps = F.when(value.rlike(NAME), F.split(value, f"(?:{ANY_OR_BARE})", -1)).otherwise(F.split(value, f"(?:{ANY})", -1))
    text_new = F.array_join(F.zip_with(gaps, new, lambda g, n: F.concat(g, F.coalesce(n, F.lit("")))), "")
    changed = joined.select("row", F.size(F.filter("found", lambda f: F.size(f["parts"]) > 0)).alias("n_entities"), text_new.alias("new"))
    both = clean.unionByName(changed)
    columns = [F.col("new").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns]
    return both.select(*columns), both
