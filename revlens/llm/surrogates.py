"""Personal data replaced by keyed surrogates, in DataFrame operations only.

Detected are mail addresses, telephone, card and identity numbers, IBANs, IP addresses,
secrets (long hexadecimal strings and access keys) and persons named with a title. Each
entity has a canonical form (digits of a number, lower case of a mail address or name), and
the canonical form gets one surrogate, whatever the way it is written: a keyed digest gives
new digits and letters, which are put into the format of each mention. So mentions of the same
entity stay mentions of the same, over the whole corpus. Numbers keep signs and country
codes, valid card numbers stay valid, mail addresses keep their last label, hexadecimal
strings their case; names keep title, gender, script and capitals. Names are replaced part by
part, and further mentions of a named person's parts in the same text are replaced too.

Surrogates are checked against each other and against all entities found: of those that
collide one keeps its surrogate and the others draw again, until all are distinct. The table
of entities is grouped and joined on Spark; only texts with entities are joined with it.

Null and empty texts stay as they are. Texts are read whole. Repeated rows get equal results.
An empty table gives an empty table. Further columns are carried along; one named n_entities is
replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import free_name, stored

#: Patterns of what counts as an entity. None can begin inside a word, and what may repeat is
#: bounded or, in secrets of any length, one class of characters: a text is read in linear time.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){1,8}"
IP = r"(?<![\p{N}.])(?:\p{Nd}{1,3}\.){3}\p{Nd}{1,3}(?!\p{N}|\.\p{N})"
PHONE = r"(?<![\p{L}\p{N}+])(?:\+\p{Nd}{1,3}(?:[ .-]?\(?\p{Nd}{2,4}\)?){2,5}|\(?\p{Nd}{3}\)?[ .-]\p{Nd}{3}[ .-]\p{Nd}{4})(?!\p{N})"
CARD = r"(?<![\p{L}\p{N}])\p{Nd}(?:[ -]?\p{Nd}){12,18}(?!\p{N})"
IDENTITY = r"(?<![\p{L}\p{N}-])\p{Nd}{3}-\p{Nd}{2}-\p{Nd}{4}(?![\p{N}-])"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\p{Nd}{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
SECRET = r"(?<![\p{L}\p{N}])(?:[0-9a-fA-F]{32,}|AKIA[0-9A-Z]{16}|(?:sk|ghp|xox[bp])[-_][A-Za-z0-9_-]{16,})(?![\p{L}\p{N}])"
MALE = "Mr|Herrn?|Monsieur|Señor|Sr|господин"
FEMALE = "Mrs|Ms|Miss|Frau|Mme|Madame|Mlle|Señora|Señorita|Sra|госпожа"
NEUTRAL = "Dr|Prof"
PERSON = rf"(?<![\p{{L}}\p{{N}}])(?:{MALE}|{FEMALE}|{NEUTRAL})\.? (?:\p{{Lu}}[\p{{Ll}}'-]{{1,40}} )?\p{{Lu}}[\p{{Ll}}'-]{{1,40}}"
ANY = "|".join((EMAIL, SECRET, IP, IBAN, IDENTITY, PHONE, CARD, PERSON))

#: What a text with an entity has in any case; quick to find.
HINT = rf"[\p{{Nd}}@]|[a-fA-F]{{32}}|sk[-_]|ghp[-_]|xox[bp][-_]|AKIA|(?:{MALE}|{FEMALE}|{NEUTRAL})[. ]"

#: Syllables of invented names by script.
LATIN, CYRILLIC = ("ba be bo da de do fa fe ga ge ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve vo", "ба бе бо да де до га ка ке ко ла ле ло ма ме мо на не но па пе ра ре ро са се со та те то ва ве во")
MAX_DRAWS = 30


def _byte(digest: Column, k: Column) -> Column:
    """Number k (modulo the length) of a digest written in hexadecimal."""
    return F.conv(F.substr(digest, F.pmod(k, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(alphabet: str, n: Column) -> Column:
    return F.substr(F.lit(alphabet), F.pmod(n, F.lit(len(alphabet))) + 1, F.lit(1))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{Nd}]", "")


def _check_digit(body: Column) -> Column:
    """The digit that makes a card number valid, for its other digits."""

    def add(total: Column, at: Column) -> Column:
        digit = F.substr(body, F.length(body) - at, F.lit(1)).cast("int")
        twice = F.when(at % 2 == 0, digit * 2).otherwise(digit)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)

    total = F.aggregate(F.sequence(F.lit(0), F.length(body) - 1), F.lit(0), add)
    return F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")


def _last(c: Column) -> Column:
    return F.substr(c, F.length(c), F.lit(1))


def _front(c: Column) -> Column:
    return F.substr(c, F.lit(1), F.length(c) - 1)


def _in_format(core: Column, kind: Column, digest: Column) -> Column:
    """``core`` with new digits and letters from the digest, in its own format."""
    lower, upper, cyrillic = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзиклмнопрстуфхцчшэюя"
    hexadecimal = (kind == "secret") & core.rlike("^[0-9a-fA-F]+$")
    capitals = core.rlike("[A-F]")

    def step(state: Column, at: Column) -> Column:
        c = F.substr(core, at, F.lit(1))
        n = _byte(digest, state["k"])
        new = (
            F.when(hexadecimal, F.when(capitals, _pick("0123456789ABCDEF", n)).otherwise(_pick("0123456789abcdef", n)))
            .when(c.rlike(r"\p{Nd}"), _pick("0123456789", n))
            .when(c.rlike(r"\p{IsCyrillic}"), F.when(c == F.upper(c), F.upper(_pick(cyrillic, n))).otherwise(_pick(cyrillic, n)))
            .when(c.rlike(r"\p{Lu}"), _pick(upper, n))
            .when(c.rlike(r"\p{L}"), _pick(lower, n))
        )
        return F.struct(F.concat(state["out"], F.coalesce(new, c)).alias("out"), (state["k"] + new.isNotNull().cast("int")).alias("k"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))
    made = F.aggregate(F.sequence(F.lit(1), F.length(core)), start, step, lambda s: s["out"])
    valid = (kind == "card") & (_check_digit(_front(_digits(core))) == _last(_digits(core)))
    return F.when(valid, F.concat(_front(made), _check_digit(_front(_digits(made))))).otherwise(made)


def _name(core: Column, kind: Column, digest: Column) -> Column:
    """An invented name of the same script, gender and capitals."""

    def syllables(text: str, count: int) -> Column:
        parts = F.array(*[F.lit(s) for s in text.split()])
        return F.concat(*[F.get(parts, F.pmod(_byte(digest, F.lit(2 * k)) * 256 + _byte(digest, F.lit(2 * k + 1)), F.size(parts))) for k in range(count)])

    cyrillic = core.rlike(r"\p{IsCyrillic}")
    stem = F.when(cyrillic, syllables(CYRILLIC, 4)).otherwise(syllables(LATIN, 4))
    end = (
        F.when(kind == "given-female", F.when(cyrillic, F.lit("на")).otherwise(F.lit("na")))
        .when(kind == "given-male", F.when(cyrillic, F.lit("н")).otherwise(F.lit("n")))
        .otherwise(F.when(cyrillic, F.lit("р")).otherwise(F.lit("r")))
    )
    name = F.concat(stem, end)
    return F.when((core == F.upper(core)) & (F.length(core) > 1), F.upper(name)).otherwise(F.initcap(name))


def _address(digest: Column) -> Column:
    return F.concat_ws(".", *[(F.pmod(_byte(digest, F.lit(k)), F.lit(254)) + 1).cast("string") for k in range(4)])


def surrogate(core: Column, kind: Column, digest: Column) -> Column:
    named = kind.startswith("given") | (kind == "surname")
    return F.when(kind == "ip", _address(digest)).when(named, _name(core, kind, digest)).otherwise(_in_format(core, kind, digest))


def parts_of(mentions: DataFrame) -> DataFrame:
    """For each distinct mention its parts in order: kind, canonical form, text, what is kept."""
    m = F.col("mention")
    title = F.regexp_extract(m, rf"^((?:{MALE}|{FEMALE}|{NEUTRAL})\.?) ", 1)
    bare = F.regexp_replace(title, r"\.$", "")
    gender = F.when(bare.rlike(f"^(?:{MALE})$"), F.lit("given-male")).when(bare.rlike(f"^(?:{FEMALE})$"), F.lit("given-female")).otherwise(F.lit("given"))
    kind = (
        F.when(m.contains("@"), F.lit("email"))
        .when(m.rlike(f"^(?:{PERSON})$"), F.lit("person"))
        .when(m.rlike(f"^(?:{SECRET})$"), F.lit("secret"))
        .when(m.rlike(f"^(?:{IP})$"), F.lit("ip"))
        .when(m.rlike(f"^(?:{IBAN})$"), F.lit("iban"))
        .when(m.rlike(f"^(?:{IDENTITY})$"), F.lit("identity"))
        .when(m.rlike(f"^(?:{PHONE})$"), F.lit("phone"))
        .otherwise(F.lit("card"))
    )

    def part(kind: Column, canon: Column, before: Column, core: Column, after: Column) -> Column:
        return F.struct(kind.alias("kind"), canon.alias("canon"), before.alias("before"), core.alias("core"), after.alias("after"))

    nothing = F.lit("")
    mail_end = F.regexp_extract(m, r"(\.[^.@]+)$", 1)
    country = F.regexp_extract(m, r"^(\+\p{Nd}{1,3}(?=[^\p{Nd}])|\+)", 1)
    code = F.when(kind == "iban", F.substring(m, 1, 2)).otherwise(F.lit(""))
    names = F.split(F.substr(m, F.length(title) + 2), " ")
    surname = F.element_at(names, -1)
    single = part(F.lit("surname"), F.lower(surname), F.concat(title, F.lit(" ")), surname, nothing)
    double = F.array(
        part(gender, F.lower(F.get(names, F.lit(0))), F.concat(title, F.lit(" ")), F.get(names, F.lit(0)), nothing),
        part(F.lit("surname"), F.lower(surname), F.lit(" "), surname, nothing),
    )
    mail = part(F.lit("email"), F.lower(m), nothing, F.substr(m, F.lit(1), F.length(m) - F.length(mail_end)), mail_end)
    call = part(F.lit("phone"), _digits(m), country, F.substr(m, F.length(country) + 1), nothing)
    plain = part(kind, F.lower(F.regexp_replace(m, r"[ -]", "")), code, F.substr(m, F.length(code) + 1), nothing)
    parts = (
        F.when(kind == "person", F.when(F.size(names) > 1, double).otherwise(F.array(single)))
        .when(kind == "email", F.array(mail))
        .when(kind == "phone", F.array(call))
        .otherwise(F.array(plain))
    )
    return mentions.select("mention", F.posexplode(parts).alias("part_no", "p")).select("mention", "part_no", "p.*")


def _dealt(df: DataFrame, column: str) -> DataFrame:
    """Rows over all tasks of a shuffle: an entity is small, but its surrogate is much work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), column)


def drawn(entities: DataFrame, key: str) -> DataFrame:
    """kind, canon, draw: the draw at which each entity's surrogate is like no other."""

    def digest(draw: Column) -> Column:
        return F.sha2(F.concat_ws("|", F.lit(key), "kind", "canon", draw.cast("string")), 512)

    # numbers of one kind must differ in their digits, names and addresses in lower case
    reals = entities.select(_compared(F.col("kind")).alias("space"), F.lower("like").alias("made"))
    left, done = entities, []
    for draw in range(MAX_DRAWS):
        made = _dealt(left, "canon").withColumn("made", F.lower(surrogate(F.col("like"), F.col("kind"), digest(F.lit(draw))))).withColumn("space", _compared(F.col("kind")))
        first = made.groupBy("space", "made").agg(F.min(F.struct("kind", "canon")).alias("who"))
        free = first.join(reals, ["space", "made"], "left_anti")
        for before in done:
            free = free.join(before, ["space", "made"], "left_anti")
        chosen = stored(free.select("space", "made", F.col("who.kind").alias("kind"), F.col("who.canon").alias("canon"), F.lit(draw).alias("draw")), "draws")
        done.append(chosen)
        left = stored(left.join(chosen, ["kind", "canon"], "left_anti"), "undrawn")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, done).select("kind", "canon", "draw")
    raise ValueError(f"{MAX_DRAWS} draws were not enough to keep all surrogates distinct")


def _compared(kind: Column) -> Column:
    """Kinds whose surrogates must not meet: all parts of names are one."""
    return F.when(kind.startswith("given") | (kind == "surname"), F.lit("name")).otherwise(kind)


def replacements(mentions: DataFrame, key: str) -> DataFrame:
    """mention, replacement, and for persons the parts: names (array of from, to)."""
    parts = stored(parts_of(mentions.select("mention").distinct()), "entity-parts")
    entities = parts.groupBy("kind", "canon").agg(F.min("core").alias("like"))
    draws = drawn(stored(entities, "entities"), key)
    seed = F.sha2(F.concat_ws("|", F.lit(key), "kind", "canon", F.col("draw").cast("string")), 512)
    made = _dealt(parts.join(draws, ["kind", "canon"]), "mention").withColumn("new", surrogate(F.col("core"), F.col("kind"), seed))
    person = F.col("kind").startswith("given") | (F.col("kind") == "surname")
    pieces = F.sort_array(F.collect_list(F.struct("part_no", F.concat("before", "new", "after").alias("text"))))
    names = F.collect_list(F.when(person, F.struct(F.col("core").alias("from"), F.col("new").alias("to"))))
    return made.groupBy("mention").agg(F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("replacement"), names.alias("names"))


def pseudonymised(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with surrogates in the text, and n_entities added."""
    text = F.col(text_col)
    found = F.coalesce(text.rlike(HINT) & text.rlike(ANY), F.lit(False))
    with_any, without = docs.filter(found), docs.filter(~found)
    key_of_row = F.xxhash64(id_col, text_col)
    mentions = with_any.select(key_of_row.alias("row"), F.posexplode(F.regexp_extract_all(text_col, F.lit(ANY), 0)).alias("at", "mention"))
    mentions = stored(mentions.distinct(), "mentions")
    new = stored(replacements(mentions, key), "replacements")
    row, put, persons = (free_name(docs, n) for n in ("row", "new", "names"))
    placed = mentions.join(new, "mention").groupBy(F.col("row").alias(row)).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("at", "replacement"))), lambda r: r["replacement"]).alias(put),
        F.array_distinct(F.flatten(F.collect_list("names"))).alias(persons),
    )
    # the text between the entities, and then a replacement for each
    between = F.split(text, ANY, -1)
    whole = F.array_join(F.flatten(F.transform(between, lambda b, k: F.array(b, F.coalesce(F.get(put, k), F.lit(""))))), "")

    def rename(done: Column, name: Column) -> Column:
        return F.regexp_replace(done, F.concat(F.lit(r"(?<![\p{L}\p{N}])"), name["from"], F.lit(r"(?![\p{L}\p{N}])")), name["to"])

    renamed = F.when(F.size(persons) > 0, F.aggregate(persons, whole, rename)).otherwise(whole)
    kept = [c for c in docs.columns if c != "n_entities"]
    changed = with_any.join(placed, key_of_row == F.col(row)).select(
        *[renamed.alias(c) if c == text_col else F.col(c) for c in kept], F.size(put).alias("n_entities")
    )
    return changed.unionByName(without.select(*kept, F.lit(0).alias("n_entities")))
