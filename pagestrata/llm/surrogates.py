"""Surrogates for personal data, in DataFrame functions only.

Entities (mail, network and card addresses, social security and telephone numbers, persons behind a form
of address) are found by one pattern in every whole text. Each different entity of the corpus gets one
replacement that is drawn from a SHA-256 of a key, its type and its plain form: digits for digits,
letters for letters in their case, names of the same gender and script. So all mentions of an entity
agree, in any spelling, in any document, and nobody without the key can tell which entity it was.

Replacements are checked against each other and against all entities of their type; of those that
clash, the first in order keeps it and the others are drawn again, until none is left. The table of
entities is written once a round; the driver reads one flag. Only documents with entities are joined
with it; an entity that most documents name is a skewed key that adaptive execution splits.

Defined cases: a null text stays null; texts without entities pass unchanged; repeated rows are
replaced alike; a null doc_id is kept; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagestrata.llm.common import pin, written

KEY = "surrogates-1"
ROUNDS = 100
# Forms of address by gender; own choice.
MALE = ("Mr", "Herr", "Señor", "Sr", "Monsieur", "господин")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "госпожа")
# Replacement names by gender and script; own choice.
NAMES = {
    "male latin": "Adam Alan Bruno Carl Daniel David Edgar Emil Felix Frank George Hugo Ivan Jonas Julian Karl Leon Lukas Martin Max Noah Oscar Otto Paul Peter Ralph Robin Samuel Simon Theo Thomas Victor".split(),
    "female latin": "Ada Alice Anna Berta Clara Diana Edith Elena Emma Eva Flora Greta Hanna Helen Ida Irene Jana Julia Karin Laura Lena Lucia Maria Martha Nina Nora Olga Paula Rosa Sara Sofia Vera".split(),
    "male cyrillic": "Александр Андрей Борис Виктор Григорий Дмитрий Иван Игорь Максим Николай Олег Павел Роман Сергей Тимофей Юрий".split(),
    "female cyrillic": "Александра Анна Вера Галина Дарья Елена Ирина Ксения Лариса Мария Наталья Ольга Полина Раиса Софья Юлия".split(),
}
SURNAMES = {
    "latin": "Abbot Bauer Becker Brandt Carver Castle Dalton Engel Fischer Forster Garner Graham Hansen Harper Holm Keller Kramer Lang Lindner Marten Miller Norton Palmer Porter Richter Sander Stone Turner Vogel Walker Weber Winter".split(),
    "cyrillic": "Белов Волков Громов Данилов Егоров Жуков Зайцев Крылов Лебедев Морозов Новиков Орлов Павлов Романов Соколов Титов".split(),
}
MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
ADDRESS = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9])"
CARD = r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9])"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"(?<![0-9A-Za-z+])(?:\+[0-9]{8,15}|(?:\+[0-9]{1,3}[ .-]?|[0-9][ .-])?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-][0-9]{3,4})(?![0-9])"
PERSON = r"(?<!\p{L})(?:" + "|".join(MALE + FEMALE) + r")\.? \p{Lu}\p{Ll}+(?:[ -]\p{Lu}\p{Ll}+)?"
ANY = "|".join((MAIL, ADDRESS, CARD, SOCIAL, PHONE, PERSON))
HINT = "[0-9@]|" + "|".join(MALE + FEMALE)
LOWER = "abcdefghijklmnopqrstuvwxyz"


def kind(form: Column) -> Column:
    """The type of an entity as it stands in the text; persons by gender and script."""
    script = F.when(form.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    gender = F.when(form.rlike(rf"^(?:{'|'.join(MALE)})\.? "), "male").otherwise("female")
    return (
        F.when(F.contains(form, F.lit("@")), "mail").when(form.rlike(rf"^(?:{ADDRESS})$"), "address")
        .when(form.rlike(rf"^(?:{CARD})$"), "card").when(form.rlike(rf"^(?:{SOCIAL})$"), "social")
        .when(form.rlike("^[0-9+(]"), "phone").otherwise(F.concat_ws(" ", F.lit("person"), gender, script))
    )


def plain(form: Column, of: Column) -> Column:
    """An entity's plain form: the same for all its spellings."""
    name = F.lower(F.regexp_replace(form, rf"^(?:{'|'.join(MALE + FEMALE)})\.? ", ""))
    return F.when(of == "mail", F.lower(form)).when(of == "address", form).when(F.startswith(of, F.lit("person")), name).otherwise(F.regexp_replace(form, "[^0-9]", ""))


def _number(seed: Column, i: Column) -> Column:
    """The ``i``-th of a stream of numbers from 0 to 65535."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", seed, i.cast("string")).cast("binary"), 256), 1, 4), 16, 10).cast("int")


def _masked(text: Column, seed: Column) -> Column:
    """Digits and lower-case letters of a text drawn anew; everything else stays."""
    def one(c, i):
        n = _number(seed, i)
        return F.when(c.rlike("[0-9]"), (n % 10).cast("string")).when(c.rlike("[a-z]"), F.substring(F.lit(LOWER), n % 26 + 1, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(text, "(?!^)(?!$)"), one), "")


def drawn(of: Column, value: Column, attempt: Column, key: str = KEY) -> Column:
    """The replacement of a plain form at an attempt, in plain form."""
    seed = F.concat_ws(":", F.lit(key), of, value, attempt.cast("string"))
    again = F.when(attempt >= 8, F.concat(F.lit("x"), attempt.cast("string"))).otherwise("")
    mail = F.concat(
        _masked(F.substring_index(value, "@", 1), F.concat(seed, F.lit(":user"))), again, F.lit("@"),
        _masked(F.regexp_replace(F.substring_index(value, "@", -1), r"\.[^.]*$", ""), F.concat(seed, F.lit(":host"))), F.lit(".example"),
    )
    address = F.concat_ws(".", (_number(seed, F.lit(0)) % 223 + 1).cast("string"), *[(_number(seed, F.lit(i)) % 256).cast("string") for i in (1, 2, 3)])
    digits = F.concat(F.substring(value, 1, 1), F.substring(_masked(value, seed), F.lit(2), F.length(value)))

    def pick(names, word, n):
        at = _number(F.concat_ws(":", F.lit(key), word, attempt.cast("string")), n) % len(names) + 1
        return F.element_at(F.array(*[F.lit(x) for x in names]), at)

    first, last = F.substring_index(value, " ", 1), F.regexp_extract(value, r"([^ -]+)$", 1)
    two = value.rlike("[ -]")
    person = F.lit(None).cast("string")
    for group, names in NAMES.items():
        families = SURNAMES[group.split()[1]]
        # Every further attempt adds a family name, so the supply of names never ends.
        family = F.array_join(F.transform(F.sequence(F.lit(0), attempt), lambda n: pick(families, last, n)), "-")
        full = F.when(two, F.concat_ws(" ", pick(names, first, F.lit(-1)), family)).otherwise(family)
        person = F.when(of == f"person {group}", F.lower(full)).otherwise(person)
    return F.when(of == "mail", mail).when(of == "address", address).when(F.startswith(of, F.lit("person")), person).otherwise(digits)


def spelled(form: Column, of: Column, new: Column) -> Column:
    """A replacement in the spelling of the mention it stands for."""
    title = F.regexp_extract(form, rf"^((?:{'|'.join(MALE + FEMALE)})\.? )", 1)

    def digit(c, i):
        return F.when(c.rlike("[0-9]"), F.substring(new, F.length(F.regexp_replace(F.substring(form, F.lit(1), i + 1), "[^0-9]", "")), F.lit(1))).otherwise(c)

    numbers = F.array_join(F.transform(F.split(form, "(?!^)(?!$)"), digit), "")
    return (
        F.when((of == "mail") & (form == F.upper(form)), F.upper(new)).when(of.isin("mail", "address"), new)
        .when(F.startswith(of, F.lit("person")), F.concat(title, F.regexp_replace(F.initcap(F.regexp_replace(new, "-", " - ")), " - ", "-"))).otherwise(numbers)
    )


def table(entities: DataFrame, key: str = KEY) -> DataFrame:
    """kind, plain and the replacement ``new`` of all entities, no two alike and none an entity itself."""
    state = written(entities.select("kind", "plain").distinct().withColumn("attempt", F.lit(0)))
    for _ in range(ROUNDS):
        state = state.withColumn("new", drawn(F.col("kind"), F.col("plain"), F.col("attempt"), key))
        known = state.select(F.col("kind").alias("_p_kind"), F.col("plain").alias("_p_plain"))
        same = Window.partitionBy("kind", "new").orderBy("attempt", "plain")
        marked = state.withColumn("_p_row", F.row_number().over(same)).join(known, (F.col("kind") == F.col("_p_kind")) & (F.col("new") == F.col("_p_plain")), "left")
        checked = written(marked.select("kind", "plain", "attempt", "new", ((F.col("_p_row") > 1) | F.col("_p_plain").isNotNull()).alias("clash")))
        if checked.where("clash").isEmpty():
            return checked.select("kind", "plain", "new")
        state = checked.select("kind", "plain", (F.col("attempt") + F.col("clash").cast("int")).alias("attempt"))
    raise ValueError("no distinct replacements found")


def replaced(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, text with replacements, n_entities."""
    hits = F.when(F.col("text").rlike(HINT), F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))
    hits = F.coalesce(hits, F.array().cast("array<string>"))
    rows = pin(docs.select("doc_id", "text"), _p_hits=hits)
    some = written(rows.where(F.size("_p_hits") > 0).withColumn("_p_mark", F.sha2(F.col("text").cast("binary"), 256)))
    mentions = some.select("doc_id", "_p_mark", "_p_hits").distinct().select("doc_id", "_p_mark", F.posexplode("_p_hits").alias("at", "form"))
    mentions = pin(mentions, kind=kind(F.col("form")))
    mentions = pin(mentions, plain=plain(F.col("form"), F.col("kind")))
    new = mentions.join(table(mentions, key), ["kind", "plain"]).select("doc_id", "_p_mark", "at", spelled(F.col("form"), F.col("kind"), F.col("new")).alias("new"))
    new = new.groupBy("doc_id", "_p_mark").agg(F.array_sort(F.collect_list(F.struct("at", "new"))).alias("_p_new"))
    new = new.withColumnsRenamed({"doc_id": "_p_id", "_p_mark": "_p_mark2"})
    both = some.join(new, some["doc_id"].eqNullSafe(new["_p_id"]) & (some["_p_mark"] == new["_p_mark2"]))
    between = F.split("text", ANY, -1)
    text = F.array_join(F.zip_with(between, F.col("_p_new.new"), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    done = both.select("doc_id", text.alias("text"), F.size("_p_hits").cast("long").alias("n_entities"))
    return rows.where(F.size("_p_hits") == 0).select("doc_id", "text", F.lit(0).cast("long").alias("n_entities")).unionByName(done)
