"""English stemming as a chain of column expressions, for tables of distinct words.

The rules are those of the published Porter2 stemmer. They are written once, as SQL that Spark and DuckDB both read; each
step is a SELECT over the one before, so that no expression grows with the number of steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.sources.shared import stored

#: The stemmer's own forms of some words, and words that stay as they are.
FORMS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
UNCHANGED = "sky news howe atlas cosmos bias andes".split()
UNCHANGED_AFTER_PLURAL = "inning outing canning herring earring proceed exceed succeed".split()
#: Suffixes of steps 2 to 4 and what they become.
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()
#: Words that a search leaves out.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()

V, C = "[aeiouy]", "[^aeiouy]"
#: Words with these beginnings have their first region behind them.
LONG_HEADS = "^(gener|commun|arsen)"


def _has(x: str, pattern: str) -> str:
    return f"regexp_extract({x}, '{pattern}', 0) <> ''"


def _region(n: int, stem: str) -> str:
    """Whether what follows the stem lies in the word's n-th region."""
    return f"(case when {_has('w', LONG_HEADS)} then {_has(stem, LONG_HEADS + f'.*{V}{C}' * (n - 1))} else {_has(stem, '.*'.join([V + C] * n))} end)"


def _short_end(stem: str) -> str:
    return f"({_has(stem, f'{C}{V}[^aeiouywxY]$')} or {_has(stem, f'^{V}{C}$')})"


def _less(x: str, n: int) -> str:
    return f"substr({x}, 1, length({x}) - {n})"


def _cut(suffixes) -> dict[str, str]:
    """The longest of the suffixes, and what stands before it."""
    pattern = f"^(.*?)({'|'.join(suffixes)})$"
    return {"stem": f"regexp_extract(w, '{pattern}', 1)", "suf": f"regexp_extract(w, '{pattern}', 2)"}


def _cases(table: dict[str, str]) -> str:
    return "case suf " + " ".join(f"when '{a}' then '{b}'" for a, b in table.items()) + " end"


def _in(x: str, values) -> str:
    return f"{x} in ({', '.join(repr(v) for v in values)})"


def steps(group: str) -> list[dict[str, str]]:
    """From column ``word`` to column ``stem``: for each step its new columns. ``group`` is how the dialect replaces all of a pattern by its first group and a letter."""
    short_word = f"({_has('stem', f'^{C}+{V}[^aeiouywxY]$')} or {_has('stem', f'^{V}{C}$')} or {_has('stem', LONG_HEADS + '$')})"
    cut_1b = f"({_in('suf', ['ed', 'edly', 'ing', 'ingly'])} and {_has('stem', V)})"
    before_e = _less("w", 1)
    return [
        {
            "fixed": f"case when length(word) <= 2 or {_in('word', UNCHANGED)} then word {' '.join(f'''when word = '{a}' then '{b}' ''' for a, b in FORMS.items())} end",
            "w": group.format("case when substr(word, 1, 1) = 'y' then concat('Y', substr(word, 2)) else word end"),
        },
        {"w": f"case when {_has('w', 'sses$')} or {_has('w', '^..+(ied|ies)$')} then {_less('w', 2)} when {_has('w', '^.?(ied|ies)$')} then {_less('w', 1)} when {_has('w', '(us|ss)$')} then w when {_has('w', f'{V}.+s$')} then {_less('w', 1)} else w end"},
        {"fixed": f"coalesce(fixed, case when {_in('w', UNCHANGED_AFTER_PLURAL)} then w end)", **_cut(["eedly", "eed", "ingly", "edly", "ing", "ed"])},
        {"w": f"case when {_in('suf', ['eed', 'eedly'])} then case when {_region(1, 'stem')} then concat(stem, 'ee') else w end when not {cut_1b} then w "
              f"when {_has('stem', '(at|bl|iz)$')} then concat(stem, 'e') when {_has('stem', '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$')} then {_less('stem', 1)} when {short_word} then concat(stem, 'e') else stem end"},
        {"w": f"case when {_has('w', f'^.+{C}[yY]$')} then concat({_less('w', 1)}, 'i') else w end"},
        _cut(STEP_2),
        {"w": f"case when suf = '' or not {_region(1, 'stem')} or (suf = 'ogi' and not {_has('stem', 'l$')}) or (suf = 'li' and not {_has('stem', '[cdeghkmnrt]$')}) then w else concat(stem, {_cases(STEP_2)}) end"},
        _cut(STEP_3),
        {"w": f"case when suf = '' or not {_region(1, 'stem')} or (suf = 'ative' and not {_region(2, 'stem')}) then w else concat(stem, {_cases(STEP_3)}) end"},
        _cut(STEP_4),
        {"w": f"case when suf = '' or not {_region(2, 'stem')} or (suf = 'ion' and not {_has('stem', '[st]$')}) then w else stem end"},
        {"w": f"case when {_has('w', 'e$')} and ({_region(2, before_e)} or ({_region(1, before_e)} and not {_short_end(before_e)})) then {before_e} when {_has('w', 'll$')} and {_region(2, before_e)} then {before_e} else w end"},
        {"stem": "coalesce(fixed, lower(w))"},
    ]


def stemmed(words: DataFrame) -> DataFrame:
    """Adds ``stem`` to a table with a column ``word`` of lower-case letters and digits: best one row for each distinct word. Null stays null.

    The result is stored: a filter or join on the stem would otherwise be pushed down through all steps, each of which repeats the
    one before several times.
    """
    # Many rules for a small table: without a number of its own it would become one task.
    kept, out = words.columns, words.repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    for new in steps("regexp_replace({}, '([aeiouy])y', '$1Y')"):
        out = out.withColumns({c: F.expr(e) for c, e in new.items()})
    return stored(out.select(*kept, "stem"))


def stem_head(stem: Column) -> Column:
    """A beginning that every word of a stem has."""
    less = F.when(F.endswith(stem, F.lit("ble")) | stem.isin(*FORMS.values()), 2).otherwise(1)
    return F.left(stem, F.greatest(F.lit(1), F.length(stem) - less))


def duck_chain(source: str, name: str) -> str:
    """CTEs of the same steps for DuckDB: ``source`` has a column word; ``name`` is the last CTE, with word and stem."""
    parts, have, before = [], {"word"}, source
    chain = steps(r"regexp_replace({}, '([aeiouy])y', '\1Y', 'g')")
    for k, new in enumerate(chain):
        at = name if k == len(chain) - 1 else f"{name}_{k}"
        kept = [c for c in sorted(have) if c not in new]
        parts.append(f"{at} as (select {', '.join([*kept, *[f'{e} as {c}' for c, e in new.items()]])} from {before})")
        have, before = have | set(new), at
    return ",\n  ".join(parts)
