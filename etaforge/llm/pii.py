"""Keyed, type-consistent surrogates for personal data, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_through

MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Don")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña")
MALE_TITLES += ("г-н", "Г-н", "господин", "Господин", "пан", "Пан", "κ", "κος", "Κος", "κύριος", "Κύριος")
FEMALE_TITLES += ("г-жа", "Г-жа", "госпожа", "Госпожа", "пані", "Пані", "κα", "Κα", "κυρία", "Κυρία")
OTHER_TITLES = ("Dr", "Prof", "д-р", "Д-р", "доктор", "Доктор", "проф", "Проф", "Δρ", "δρ")
MALE_NAMES = ("Adam", "Boris", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Noah", "Oscar", "Paul")
FEMALE_NAMES = ("Alice", "Berta", "Clara", "Diana", "Emma", "Flora", "Greta", "Helena", "Ida", "Julia", "Klara", "Lena", "Marta", "Nora", "Olga", "Paula")
SURNAME_PARTS = ("al", "ber", "cor", "dan", "el", "fer", "gar", "hol", "in", "jor", "kel", "lin", "mor", "nel", "or", "per")
# The same in Cyrillic letters, in the order above.
CYRILLIC_PARTS = ("ал", "бер", "кор", "дан", "ел", "фер", "гар", "хол", "ин", "йор", "кел", "лин", "мор", "нел", "ор", "пер")
CYRILLIC_MALE = ("Адам", "Борис", "Карл", "Давид", "Эмиль", "Феликс", "Георг", "Гуго", "Иван", "Йонас", "Кирилл", "Леон", "Мартин", "Ной", "Оскар", "Павел")
CYRILLIC_FEMALE = ("Алиса", "Берта", "Клара", "Диана", "Эмма", "Флора", "Грета", "Елена", "Ида", "Юлия", "Кира", "Лена", "Марта", "Нора", "Ольга", "Паула")
GREEK_PARTS = ("αλ", "βερ", "κορ", "δαν", "ελ", "φερ", "γαρ", "χολ", "ιν", "ιορ", "κελ", "λιν", "μορ", "νελ", "ορ", "περ")
GREEK_MALE = ("Αδάμ", "Βασίλης", "Κάρολος", "Δαβίδ", "Αιμίλιος", "Φίλιππος", "Γιώργος", "Ηλίας", "Ιωάννης", "Ιάσων", "Κώστας", "Λέων", "Μάρτιος", "Νώε", "Όμηρος", "Παύλος")
GREEK_FEMALE = ("Αλίκη", "Βέρα", "Κλαίρη", "Νταϊάνα", "Έμμα", "Φλώρα", "Γκρέτα", "Ελένη", "Ίντα", "Ιουλία", "Κλειώ", "Λένα", "Μάρθα", "Νόρα", "Όλγα", "Παυλίνα")

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
SECRET = r"(?<![0-9A-Za-z])(?=[0-9A-Fa-f]*[0-9])(?:[0-9A-Fa-f]{32,64})(?![0-9A-Za-z])|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"
CARD = r"(?<![0-9.])(?:[0-9]{4}[ -]?){3}[0-9]{4}(?![0-9])|(?<![0-9.])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9])"
PHONE = r"(?<![0-9A-Za-z])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])"
TITLE = rf"(?:{'|'.join(MALE_TITLES + FEMALE_TITLES + OTHER_TITLES)})\.? "
# One word with its hyphens and apostrophes; up to three more may follow, initials and particles between.
NAME_WORD = r"\p{Lu}[\p{L}\p{M}]+(?:[-'’]\p{Lu}[\p{L}\p{M}]+)*|\p{Lu}['’]\p{Lu}[\p{L}\p{M}]+(?:-\p{Lu}[\p{L}\p{M}]+)*"
BETWEEN = r"(?:\p{Lu}\.|van|von|de|der|den|del|della|di|da|dos|du|la|le|el|al|bin|ibn|ter|ten|zu|y) "
NAME = rf"(?<![\p{{L}}\p{{M}}])(?:{TITLE})+(?:{BETWEEN}){{0,3}}(?:{NAME_WORD})(?: (?:{BETWEEN}){{0,3}}(?:{NAME_WORD})){{0,3}}"
KINDS = {"email": EMAIL, "secret": SECRET, "iban": IBAN, "card": CARD, "ssn": SSN, "ip": IP, "phone": PHONE, "name": NAME}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: What every text with an entity has: a digit, an at sign or a title before a name.
MAYBE = rf"[0-9@]|AKIA[A-Z]|gh[pousr]_|{TITLE}(?:\p{{Lu}}|{BETWEEN})"
KEY = "surrogates-1"


def _kind(value: Column) -> Column:
    """First kind, in the order of KINDS, that matches the whole value; what is left is a name without title."""
    out = None
    for kind, p in KINDS.items():
        test = value.rlike(f"^(?:{p})$")
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("name")


def _coreferent(kind: Column, value: Column) -> Column:
    """What two spellings of one entity share: letter case of mail, signs in numbers."""
    return (
        F.when(kind.isin("email", "secret", "surname", "given"), F.lower(value))
        .when(kind.isin("card", "phone", "ssn", "iban"), F.regexp_replace(value, "[^0-9A-Z]", ""))
        .otherwise(value)
    )


def _gender(value: Column) -> Column:
    title = F.regexp_extract(value, r"^([\p{L}-]+)", 1)
    return F.when(title.isin(*MALE_TITLES), "m").when(title.isin(*FEMALE_TITLES), "f").otherwise("u")


def _digest(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", F.lit(key), kind, norm, attempt.cast("string")), 512)


def _fill() -> str:
    """SQL: the normal form with every letter and digit replaced by one the digest `d` picks.

    Case and kind of each sign are kept; hex secrets stay hex. The first digit of a card, the last four digits' format,
    the country of an IBAN and of a phone number stay.
    """
    nth = "cast(conv(substr(d, 1 + (2 * i) % 126, 2), 16, 10) as int)"
    return f"""array_join(transform(sequence(1, length(norm)), i -> case
        when kind = 'card' and i = 1 then substr(norm, i, 1)
        when kind = 'iban' and i <= 2 then substr(norm, i, 1)
        when kind = 'phone' and i = 1 then substr(norm, i, 1)
        when kind = 'secret' and norm rlike '^[0-9a-f]+$' then substr('0123456789abcdef', 1 + {nth} % 16, 1)
        when substr(norm, i, 1) rlike '[0-9]' then cast({nth} % 10 as string)
        when substr(norm, i, 1) rlike '[A-Z]' then char(65 + {nth} % 26)
        when substr(norm, i, 1) rlike '[a-z]' then char(97 + {nth} % 26)
        else substr(norm, i, 1) end), '')"""


def _sql_array(values: tuple[str, ...]) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def _surrogate() -> str:
    """SQL: the surrogate's normal form, from kind, norm, gender and digest d."""
    def n(at: int, size: int) -> str:
        return f"cast(conv(substr(d, {at}, 4), 16, 10) as int) % {size} + 1"

    def by_script(part):
        cyrillic, greek = part(CYRILLIC_PARTS, CYRILLIC_MALE, CYRILLIC_FEMALE), part(GREEK_PARTS, GREEK_MALE, GREEK_FEMALE)
        latin = part(SURNAME_PARTS, MALE_NAMES, FEMALE_NAMES)
        return f"lower(case when norm rlike '\\\\p{{IsCyrillic}}' then {cyrillic} when norm rlike '\\\\p{{IsGreek}}' then {greek} else {latin} end)"

    def surname(parts, male, female):
        return "concat(" + ", ".join(f"element_at({_sql_array(parts)}, {n(at, 16)})" for at in (5, 9, 13, 17, 21)) + ")"

    def given(parts, male, female):
        pick = f"case when gender = 'm' then element_at({_sql_array(male)}, {n(1, 16)}) when gender = 'f' then element_at({_sql_array(female)}, {n(1, 16)}) else element_at({_sql_array(male + female)}, {n(1, 32)}) end"
        # The listed names are few: from the second attempt on a second part makes them as many as surnames.
        return f"case when attempt = 0 then {pick} else concat({pick}, '-', {surname(parts, male, female)}) end"

    return f"""case kind
        when 'email' then concat('user', substr(d, 1, 14), '@example.', element_at(array('com', 'org', 'net'), {n(60, 3)}))
        when 'ip' then concat(11 + cast(conv(substr(d, 7, 4), 16, 10) as int) % 213, '.', cast(conv(substr(d, 1, 2), 16, 10) as int), '.', cast(conv(substr(d, 3, 2), 16, 10) as int), '.', cast(conv(substr(d, 5, 2), 16, 10) as int))
        when 'surname' then {by_script(surname)}
        when 'given' then {by_script(given)}
        else {_fill()} end"""


def _format() -> str:
    """SQL: surrogate normal form written in the value's own format (signs between, case of a secret or a name's word).

    A secret without small letters gets none; else each sign takes the case of the value's sign at its place.
    """
    return """case when kind in ('card', 'phone', 'ssn', 'iban') then
        array_join(transform(sequence(1, length(value)), i -> case when substr(value, i, 1) rlike '[0-9A-Z]'
            then substr(made, 1 + length(regexp_replace(substr(value, 1, i - 1), '[^0-9A-Z]', '')), 1) else substr(value, i, 1) end), '')
        when kind in ('surname', 'given') and value = upper(value) then upper(made)
        when kind in ('surname', 'given') then array_join(transform(split(made, '-'), x -> initcap(x)), '-')
        when kind in ('email', 'secret') and value = upper(value) then upper(made)
        when kind = 'secret' then array_join(transform(sequence(1, length(value)), i -> case when substr(value, i, 1) rlike '[A-Z]'
            then upper(substr(made, i, 1)) else substr(made, i, 1) end), '')
        else made end"""


def surrogates(values: DataFrame, key: str = KEY) -> DataFrame:
    """value, kind, surrogate of distinct values; of a name each given name and the surname (its last word) are
    entities of their own, so 'Mr John Smith', 'Smith' and 'Dr. Smith' share a surname's surrogate. One row per entity is drawn and checked for collisions.

    An entity's surrogate must be no entity of the corpus and no other entity's surrogate, per kind.
    Of several entities with one surrogate the smallest keeps it and the others draw again with
    the next attempt number, until none collides. A surrogate is a function of the key and the set of
    entities alone.
    """
    kinds = write_through(values.select("value", _kind(F.col("value")).alias("kind")), "pii-kinds")
    whole = kinds.where("kind <> 'name'").select("value", "kind", F.lit(0).alias("place"), F.col("value").alias("word"), F.lit("").alias("gender"))
    words = F.split(_untitled(F.col("value")), " ")
    named = kinds.where("kind = 'name'").select("value", F.size(words).alias("n"), F.posexplode(words).alias("place", "word"))
    part = F.when(F.col("place") == F.col("n") - 1, "surname").when(F.col("word").rlike(rf"^(?:{NAME_WORD})$"), "given").otherwise("as is")
    named = named.select("value", part.alias("kind"), "place", "word", F.when(part == "given", _gender(F.col("value"))).otherwise("").alias("gender"))
    kinds = whole.unionByName(named).withColumn("norm", _coreferent(F.col("kind"), F.col("word")))
    kinds = write_through(kinds, "pii-values")
    entities = kinds.where("kind <> 'as is'").groupBy("kind", "norm").agg(F.min("gender").alias("gender"))  # 'f' and 'm' go before 'u'
    known = write_through(entities, "pii-entities")
    todo, done, attempt = known, None, 0
    while True:
        drawn = todo.withColumn("d", _digest(key, F.col("kind"), F.col("norm"), F.lit(attempt))).withColumn("attempt", F.lit(attempt)).withColumn("made", F.expr(_surrogate())).drop("d", "attempt")
        taken = known.select("kind", F.col("norm").alias("made"), F.lit("").alias("first"))
        if done is not None:
            taken = taken.union(done.select("kind", "made", F.lit("").alias("first")))
        # '' sorts before every norm, so a taken surrogate has no rightful owner among the new ones.
        owner = taken.union(drawn.select("kind", "made", F.col("norm").alias("first"))).groupBy("kind", "made").agg(F.min("first").alias("first"))
        drawn = write_through(drawn.join(owner, ["kind", "made"]), "pii-drawn")
        good = drawn.where("norm = first").select("kind", "norm", "made")
        done = good if done is None else done.union(good)
        todo = drawn.where("norm <> first").select("kind", "norm", "gender")
        if todo.isEmpty():
            break
        attempt += 1
    written = kinds.join(done, ["kind", "norm"], "left").withColumnsRenamed({"value": "whole", "word": "value"})
    written = written.select("whole", "kind", "place", F.when(F.col("kind") == "as is", F.col("value")).otherwise(F.expr(_format())).alias("new"))
    # The words of one value meet in one row: four, and the particles between.
    joined = written.groupBy("whole").agg(F.array_sort(F.collect_list(F.struct("place", "new"))).alias("parts"), F.min("kind").alias("kind"))
    is_name = F.col("kind").isin("as is", "given", "surname")
    title = F.when(is_name, F.regexp_extract("whole", rf"^(?:{TITLE})+", 0)).otherwise("")
    return joined.select(
        F.col("whole").alias("value"),
        F.when(is_name, "name").otherwise(F.col("kind")).alias("kind"),
        F.concat(title, F.array_join("parts.new", " ")).alias("surrogate"),
    )


def _untitled(name: Column) -> Column:
    return F.regexp_replace(name, rf"^(?:{TITLE})+", "")


def _with_mentions(found: DataFrame, text: str) -> DataFrame:
    """`_pattern` and `_pii` that also find the document's own full names and surnames where no title stands."""
    full = F.transform(F.filter("_pii", lambda v: v.rlike(f"^(?:{NAME})$")), _untitled)
    own = F.concat(full, F.transform(full, lambda v: F.element_at(F.split(v, " "), -1)))
    capitals = F.filter(own, lambda v: v == F.upper(v))
    forms = F.array_distinct(F.concat(own, F.transform(own, F.upper), F.transform(capitals, F.initcap)))
    longest = F.transform(F.array_sort(F.transform(forms, lambda v: F.struct((-F.length(v)).alias("n"), v.alias("v")))), lambda x: F.concat(F.lit(r"\Q"), x["v"], F.lit(r"\E")))
    mention = F.concat(F.lit(PATTERN + r"|(?<![\p{L}\p{M}])(?:"), F.array_join(longest, "|"), F.lit(r")(?![\p{L}\p{M}])"))
    named = F.size(full) > 0
    out = found.withColumn("_pattern", F.when(named, mention).otherwise(F.lit(PATTERN)))
    return out.withColumn("_pii", F.when(F.col("_pattern") == PATTERN, F.col("_pii")).otherwise(F.regexp_extract_all(F.col(text), F.col("_pattern"), F.lit(0))))


def replace_pii(docs: DataFrame, key: str = KEY, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """All columns of docs, text with surrogates in place of entities, and n_pii (entities replaced).

    Equal entities get equal surrogates in all documents, different ones different ones. A null
    text stays null with n_pii 0; texts without entities pass unchanged and are never shuffled.
    Repeated rows and null ids are all kept. Other columns are carried along untouched.
    """
    # Most texts have no sign that any entity needs; only the others meet the long pattern, once.
    may = F.coalesce(F.col(text).rlike(MAYBE), F.lit(False))
    found = write_through(docs.where(may).withColumn("_pii", F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))), "pii-texts")
    bare = docs.where(~may).unionByName(found.where(F.size("_pii") == 0).drop("_pii"))
    found = _with_mentions(found, text)
    hit = found.where(F.size("_pii") > 0)
    pairs = write_through(hit.select(F.col(id_col).alias("_id"), F.explode(F.array_distinct("_pii")).alias("value")), "pii-pairs")
    made = write_through(surrogates(pairs.select("value").distinct(), key), "pii-map")
    # The entities of a document, not of a value, meet in one row: bounded by the length of its text.
    maps = (
        pairs.distinct()
        .join(made, "value")
        .groupBy("_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("value", "surrogate"))).alias("_map"))
    )
    joined = hit.join(maps, F.col(id_col).eqNullSafe(F.col("_id")))
    parts = F.split(F.col(text), F.col("_pattern"), -1)
    fresh = F.transform("_pii", lambda v: F.element_at(F.col("_map"), v))
    rebuilt = F.array_join(F.zip_with(parts, fresh, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    done = joined.withColumn("n_pii", F.size("_pii")).withColumn(text, rebuilt)
    cols = [*docs.columns, "n_pii"]
    return done.select(*cols).unionByName(bare.withColumn("n_pii", F.lit(0)).select(*cols))
