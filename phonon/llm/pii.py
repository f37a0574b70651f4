"""Personal data replaced by keyed surrogates (operator 5), DataFrame functions only.

Detected kinds: e-mail, IPv4 address, phone, social security number, IBAN,
card or account number, and person names behind a title. A surrogate keeps the
kind, length and format (digits stay digits in the same separators, letters
keep script and case, Luhn-valid numbers stay valid, given names keep the
title's gender, names keep their script) and depends only on the secret key and
the normalised entity, so one entity has one surrogate everywhere.

How it runs
-----------
1. Matches of one combined pattern; texts without a digit, an @ or a title are
   passed over by a cheap test first.
2. The distinct entities (partial aggregates, so a frequent one costs a row per
   task) get a surrogate from a keyed hash. A surrogate taken by two entities,
   or equal to an entity of the corpus, stays with at most one; the others draw
   again with the next attempt, until all differ. Rounds are stored tables.
3. Matches are joined with their surrogates, per distinct text. Only texts with
   an entity are shuffled, and the rebuilt text is the gaps and surrogates in
   turn. The other rows pass straight through.
4. Names found behind a title are carried to their other mentions in the same
   text: the family name as a whole word, the given name before a family name.
   One person keeps one given name whatever the title. Limits: a name that no
   title introduces anywhere in the text, a given name alone and initials stay,
   and a family name that is also a common word is replaced in that text too.

Defined results: a null or empty text stays as it is with no entities; null and
repeated ids are kept, row by row; an empty table gives an empty result; texts are read
whole, however long; all columns are kept, and if one is called like the count, the count gets
underscores in front. No name is carried in a text that holds U+F8F0 or U+F8F1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phonon.llm.common import fresh, store

# Titles by the gender they tell.
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Госпожа", "Κυρία")
NEUTRAL = ("Dr", "Prof")
_TITLE = "(?:" + "|".join(sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True)) + ")"
_WORD = r"\p{Lu}\p{Ll}{1,24}"

_LOCAL = r"[\p{L}\p{N}._%+-]"
EMAIL = rf"(?<!{_LOCAL}){_LOCAL}++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
IP = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = (r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])"
         r"|(?<![0-9+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])"
         r"|(?<![0-9-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9-])")
CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])"
GIVEN = rf"(?<!\p{{L}})({_TITLE}\.? {_WORD})(?= {_WORD})"        # group 1
SECOND = rf"(?<=(?<!\p{{L}}){_TITLE}\.? {_WORD} ){_WORD}(?!\p{{L}})"
FAMILY = rf"(?<!\p{{L}}){_TITLE}\.? {_WORD}(?!\p{{L}})"
# A look ahead at one character class keeps the rest of each branch from being tried at every place.
_CAPITALS = "".join(sorted({t[0] for t in MALE + FEMALE + NEUTRAL}))
ANY = "|".join((rf"(?=[{_CAPITALS}]){GIVEN}", rf"(?=\p{{Lu}}){SECOND}", rf"(?=[{_CAPITALS}]){FAMILY}",
                rf"(?={_LOCAL}){EMAIL}", rf"(?=[A-Z]){IBAN}", rf"(?=[0-9+(])(?:{IP}|{SSN}|{PHONE}|{CARD})"))
HINT = rf"[0-9@]|(?=[{_CAPITALS}]){_TITLE}\.? \p{{Lu}}"

# Surrogate names: syllables by script and endings by gender.
ONSETS = {"latin": "b d f g k l m n p r s t v z", "cyrillic": "б д ф г к л м н п р с т в з",
          "greek": "β δ φ γ κ λ μ ν π ρ σ τ θ ζ"}
VOWELS = {"latin": "a e i o u", "cyrillic": "а е и о у", "greek": "α ε ι ο υ"}
ENDINGS = {"latin": {"given_m": "n r x", "given_f": "a ia ina", "given_x": "is y e", "family": "l k t"},
           "cyrillic": {"given_m": "н р й", "given_f": "а ия ина", "given_x": "и ы е",
                        "family": "л к т"},
           "greek": {"given_m": "ς ων ης", "given_f": "α ια ινα", "given_x": "ι υ ε",
                     "family": "λ κ ου"}}
GIVEN_KINDS = ("given_m", "given_f", "given_x")
OPEN, CLOSE = "\uf8f0", "\uf8f1"      # private characters around the number of a carried name
DIGITS = ("phone", "ssn", "card")
KEEPS_FIRST = ("phone",)


def _lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _array(words: str) -> str:
    return "array(" + ", ".join(_lit(w) for w in words.split()) + ")"


def _kind(m: str) -> str:
    """SQL: kind of a match ``m`` (struct of whole and given)."""
    def titled(titles):
        return f"{m}.whole RLIKE {_lit('^(?:' + '|'.join(titles) + ')[. ]')}"
    return (f"CASE WHEN {m}.given <> '' THEN CASE WHEN {titled(MALE)} THEN 'given_m' "
            f"WHEN {titled(FEMALE)} THEN 'given_f' ELSE 'given_x' END "
            f"WHEN {m}.whole LIKE '%@%' THEN 'email' "
            f"WHEN {m}.whole RLIKE {_lit('^' + IP + '$')} THEN 'ip' "
            f"WHEN {m}.whole RLIKE {_lit('^' + SSN + '$')} THEN 'ssn' "
            f"WHEN {m}.whole RLIKE {_lit('^(?:' + CARD + ')$')} THEN 'card' "
            f"WHEN {m}.whole RLIKE {_lit('^[A-Z]{2}[0-9]')} THEN 'iban' "
            f"WHEN {m}.whole RLIKE '[0-9]' THEN 'phone' ELSE 'family' END")


def _norm() -> str:
    """SQL over (kind, raw): what makes two mentions the same entity."""
    return ("CASE WHEN kind IN ('phone', 'ssn', 'card') THEN regexp_replace(raw, '[^0-9]', '') "
            "WHEN kind = 'iban' THEN upper(replace(raw, ' ', '')) "
            "WHEN kind IN ('email', 'ip') THEN lower(raw) "
            "ELSE lower(regexp_extract(raw, '([^ ]+)$', 1)) END")


def _luhn(digits: str) -> str:
    """SQL: Luhn sum of a digit string (0 modulo 10 when valid)."""
    return (f"aggregate(transform(split(reverse({digits}), ''), (c, i) -> CASE WHEN i % 2 = 0 THEN "
            "cast(c as int) WHEN cast(c as int) * 2 > 9 THEN cast(c as int) * 2 - 9 "
            "ELSE cast(c as int) * 2 END), 0, (s, y) -> s + y)")


def _draw(key: str) -> str:
    """SQL over (kind, norm, attempt): a surrogate of the same kind and format."""
    salt = f"concat_ws('|', {_lit(key)}, kind, norm, cast(attempt as string)"
    stream = f"concat(sha2({salt}, '0'), 256), sha2({salt}, '1'), 256))"

    def byte(i: str) -> str:       # i-th byte of the hash stream, from 0
        return f"cast(conv(substring(h, cast(2 * (({i}) % 64) + 1 as int), 2), 16, 10) as int)"

    digit = f"cast({byte('i')} % 10 as string)"
    free = f"array_join(transform(split(norm, ''), (c, i) -> {digit}), '')"
    phone = (f"CASE WHEN length(norm) > 10 THEN concat(left(norm, 1), substring({free}, 2)) "
             f"ELSE {free} END")
    check = _luhn("concat(b, '0')")
    card = (f"CASE WHEN {_luhn('norm')} % 10 = 0 THEN " + _let(
        f"left({free}, length(norm) - 1)", "b",
        f"concat(b, cast((10 - {check} % 10) % 10 as string))") + f" ELSE {free} END")
    ip = ("concat_ws('.', " + ", ".join(f"cast(1 + {byte(str(k))} % 254 as string)"
                                        for k in range(4)) + ")")
    alphabets = (("[a-z]", "abcdefghijklmnopqrstuvwxyz"), ("[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
                 ("\\\\p{IsCyrillic}", "абвгдежзиклмнопрстуфхцчшэюя"),
                 ("\\\\p{IsGreek}", "αβγδεζηθικλμνξοπρστυφχψω"), ("\\\\p{IsLatin}", "áàâäéèêëíîïóôöúùûüñç"))
    letters = "CASE WHEN c RLIKE '[0-9]' THEN " + digit + " " + " ".join(
        f"WHEN c RLIKE '^{cls}$' THEN substring('{chars}', {byte('i')} % {len(chars)} + 1, 1)"
        for cls, chars in alphabets) + " ELSE c END"
    spelled = f"array_join(transform(split(norm, ''), (c, i) -> {letters}), '')"
    # the top-level domain of an address and the country of an account number stay
    email = _let("regexp_extract(norm, '([.][^.]*)$', 1)", "tld",
                 f"concat(left(h, greatest(0, attempt - 5)), "     # short ones grow when taken
                 f"left({spelled}, length(norm) - length(tld)), tld)")
    iban = f"concat(left(norm, 2), substring({spelled}, 3))"
    names = []
    for script, test in (("cyrillic", "norm RLIKE '\\\\p{IsCyrillic}'"),
                         ("greek", "norm RLIKE '\\\\p{IsGreek}'"), ("latin", "true")):
        on, vo = ONSETS[script].split(), VOWELS[script].split()
        body = (f"array_join(transform(sequence(1, 3 + cast(attempt div 3 as int)), k -> concat("
                f"element_at({_array(ONSETS[script])}, {byte('2 * k')} % {len(on)} + 1), "
                f"element_at({_array(VOWELS[script])}, {byte('2 * k + 1')} % {len(vo)} + 1))), '')")
        end = "CASE " + " ".join(
            f"WHEN kind = '{kind}' THEN element_at({_array(words)}, "
            f"{byte('0')} % {len(words.split())} + 1)"
            for kind, words in ENDINGS[script].items()) + " ELSE '' END"
        names.append(f"WHEN {test} THEN concat({body}, {end})")
    name = "CASE " + " ".join(names) + " END"
    return _let(stream, "h", f"CASE WHEN kind = 'ip' THEN {ip} WHEN kind = 'email' THEN {email} "
                f"WHEN kind = 'iban' THEN {iban} WHEN kind = 'phone' THEN {phone} "
                f"WHEN kind = 'card' THEN {card} WHEN kind = 'ssn' THEN {free} ELSE {name} END")


def _shown() -> str:
    """SQL over (kind, raw, surrogate): the surrogate in the mention's own format."""
    filled = ("array_join(transform(split(raw, ''), (c, i) -> CASE WHEN c RLIKE '[0-9]' THEN "
              "substring(surrogate, length(regexp_replace(left(raw, i + 1), '[^0-9]', '')), 1) "
              "ELSE c END), '')")
    spaced = ("array_join(transform(split(raw, ''), (c, i) -> CASE WHEN c = ' ' THEN c ELSE "
              "substring(surrogate, length(replace(left(raw, i + 1), ' ', '')), 1) END), '')")
    cased = "CASE WHEN raw = upper(raw) THEN upper(surrogate) ELSE surrogate END"
    title = "left(raw, length(raw) - length(regexp_extract(raw, '([^ ]+)$', 1)))"
    return (f"CASE WHEN kind IN ('phone', 'ssn', 'card') THEN {filled} WHEN kind = 'iban' THEN "
            f"{spaced} WHEN kind IN ('email', 'ip') THEN {cased} "
            f"ELSE concat({title}, initcap(surrogate)) END")


def _carried(gap: str, people: str) -> str:
    """SQL: the text between entities with every other mention of the text's own names marked by its
    number: a given name before one of the family names, a family name anywhere, as whole words."""
    families = f"array_join(transform(filter({people}, p -> p.last), p -> p.raw), '|')"
    pattern = (f"CASE WHEN n.last THEN concat('(?<!\\\\p{{L}})', n.raw, '(?!\\\\p{{L}})') "
               f"ELSE concat('(?<!\\\\p{{L}})', n.raw, '(?= (?:', {families}, "
               f"'|{OPEN}[0-9]+{CLOSE})(?!\\\\p{{L}}))') END")
    # an array of (place, name), given names (last = false) first
    numbered = f"transform({people}, (p, i) -> struct(i AS i, p.last AS last, p.raw AS raw))"
    return (f"aggregate({numbered}, {gap}, (t, n) -> CASE WHEN instr(t, n.raw) > 0 THEN regexp_replace(t, {pattern}, "
            f"concat('{OPEN}', cast(n.i AS string), '{CLOSE}')) ELSE t END)")


def _restored(gap: str, people: str) -> str:
    """SQL: marks replaced by the surrogates of their names."""
    numbered = f"transform({people}, (p, i) -> struct(i AS i, p.shown AS shown))"
    return (f"aggregate({numbered}, {gap}, (t, n) -> replace(t, concat('{OPEN}', cast(n.i AS string), '{CLOSE}'), "
            "n.shown))")


def surrogates(entities: DataFrame, key: str, max_rounds: int = 40) -> DataFrame:
    """(kind, norm, surrogate): distinct surrogates of the distinct (kind, norm) of ``entities``."""
    known = store(entities.select("kind", "norm").distinct(), "pii-entities")
    todo, parts = known.withColumn("attempt", F.lit(0)), []
    taken: DataFrame | None = None
    for rnd in range(max_rounds):
        drawn = todo.withColumn("surrogate", F.expr(_draw(key)))
        # free: no entity of the corpus and no settled surrogate of the kind; the least hash wins
        blocked = known.select("kind", F.col("norm").alias("surrogate"))
        if taken is not None:
            blocked = blocked.unionByName(taken.select("kind", "surrogate")).distinct()
        blocked = blocked.withColumn("blocked", F.lit(True))
        first = drawn.groupBy("kind", "surrogate").agg(
            F.min(F.struct(F.xxhash64("norm"), F.col("norm"))["norm"]).alias("winner"))
        judged = drawn.join(first, ["kind", "surrogate"]).join(
            blocked, ["kind", "surrogate"], "left").withColumn(
            "won", F.col("blocked").isNull() & (F.col("norm") == F.col("winner")))
        judged = store(judged.select("kind", "norm", "attempt", "surrogate", "won"), f"pii{rnd}")
        parts.append(judged.where("won").select("kind", "norm", "surrogate"))
        taken = parts[-1] if taken is None else taken.unionByName(parts[-1])
        todo = judged.where("NOT won").select(
            "kind", "norm", (F.col("attempt") + 1).alias("attempt"))
        if todo.isEmpty():
            return taken
    raise RuntimeError("surrogates still collide; the corpus has too many entities of a short kind")


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text",
                 count_col: str = "n_entities") -> DataFrame:
    """``docs`` with surrogates in ``text_col`` and the number of replaced mentions."""
    digest, gaps, new, people, more = fresh(docs, "digest", "gaps", "new", "people", "more")
    count_name = count_col if count_col.lower() not in {c.lower() for c in docs.columns} else fresh(docs, count_col)[0]
    text = F.col(text_col)
    has_any = F.coalesce(F.when(text.rlike(HINT), text.rlike(ANY)), F.lit(False))
    # the texts with an entity, stored: the mentions and the rebuilt texts both read them
    hit = store(docs.where(has_any).withColumn(digest, F.sha2(text, 256)), "pii-texts")
    # per distinct text: its mentions in order
    mentions = hit.select(F.col(digest).alias("digest"), F.expr(
        f"posexplode(zip_with(regexp_extract_all(`{text_col}`, {_lit(ANY)}, 0), "
        f"regexp_extract_all(`{text_col}`, {_lit(ANY)}, 1), "
        "(w, g) -> named_struct('whole', w, 'given', g)))").alias("pos", "m"))
    mentions = mentions.distinct().select("digest", "pos", F.expr(_kind("m")).alias("kind"),
                                          F.col("m.whole").alias("raw"))
    mentions = mentions.withColumn("norm", F.expr(_norm()))
    # one person keeps one given name: behind a neutral title the gender is that of the same name
    # behind another title of the text (the male one if both occur)
    told = F.min(F.when(F.col("kind").isin("given_m", "given_f"), F.concat(F.when(
        F.col("kind") == "given_m", "0").otherwise("1"), "kind"))).over(Window.partitionBy("digest", "norm"))
    mentions = store(mentions.withColumn("kind", F.when(
        F.col("kind") == "given_x", F.coalesce(F.substring(told, 2, 9), F.col("kind"))).otherwise(F.col("kind"))),
        "pii-mentions")
    table = store(surrogates(mentions, key), "pii-map")
    word = "regexp_extract({}, '([^ ]+)$', 1)"
    shown = mentions.join(table, ["kind", "norm"]).withColumn("shown", F.expr(_shown())).select(
        "digest", F.struct("pos", "shown").alias("s"),
        F.when(F.col("kind").isin("family", *GIVEN_KINDS), F.struct(
            (F.col("kind") == "family").alias("last"), F.expr(word.format("raw")).alias("raw"),
            F.expr(word.format("shown")).alias("shown"))).alias("name"))
    lists = shown.groupBy(F.col("digest").alias(digest)).agg(
        F.sort_array(F.collect_list("s")).alias(new), F.array_sort(F.collect_set("name")).alias(people))
    marked = f"transform({gaps}, g -> {_carried('g', people)})"
    carried = f"aggregate({gaps}, 0L, (n, g) -> n + regexp_count(g, '{OPEN}[0-9]+{CLOSE}'))"
    rebuilt = (f"array_join(zip_with(transform({gaps}, g -> {_restored('g', people)}), {new}, "
               "(g, s) -> concat(g, coalesce(s.shown, ''))), '')")
    done = (hit.join(lists, digest)
            .withColumn(people, F.when(text.rlike(f"[{OPEN}{CLOSE}]"), F.slice(people, 1, 0)).otherwise(F.col(people)))
            .withColumn(gaps, F.split(text, ANY, -1))
            .withColumn(gaps, F.expr(marked))
            .withColumn(more, F.expr(carried))
            .withColumn(text_col, F.expr(rebuilt))
            .withColumn(count_name, F.size(new).cast("long") + F.col(more)))
    rest = docs.where(~has_any).withColumn(count_name, F.lit(0).cast("long"))
    return done.select(*[F.col(f"`{c}`") for c in rest.columns]).unionByName(rest)
