"""Text functions: columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that key points leave out.
STUDY_STOP_WORDS = (
    "the a an is are was were be been being what which who whom how why when where of in on for to and or with from by as at "
    "it its this that these those explain describe discuss following using used question"
).split()
#: Figure types by their other names.
FIGURE_TYPES = {
    "diagram": ["diagram", "diagrams"],
    "graph": ["graph", "graphs", "plot", "plots"],
    "math_figure": ["math_figure", "math", "mathfigure", "math-figure", "mathematical figure", "mathematical-figure", "equation", "formula"],
    "table": ["table", "tables", "tabular"],
    "chart": ["chart", "charts", "bar chart", "bar-chart", "barchart", "pie chart", "pie-chart", "piechart", "line chart", "histogram"],
    "photo": ["photo", "photos", "photograph", "photographs", "image", "figure"],
}
QUIZ_FIGURE_TYPES = {
    "diagram": ["diagram", "diagrams"],
    "graph": ["graph", "graphs", "plot", "plots"],
    "math_figure": ["math_figure", "mathfigure", "math", "mathematical_figure", "formula", "equation"],
    "table": ["table", "tables"],
    "chart": ["chart", "charts", "bar_chart", "pie_chart", "line_chart", "histogram"],
    "photo": ["photo", "photos", "photograph", "image", "images", "figure", "figures"],
}
#: Diagram kinds with their words and phrases, first rule first.
DIAGRAM_RULES = [
    ("flowchart", ["flowchart", "flow chart", "flow diagram"]),
    ("circuit", ["circuit", "resistor", "capacitor", "inductor", "transistor", "diode", "op amp", "opamp", "breadboard", "kirchhoff", "logic gate"]),
    ("chart", ["bar chart", "barchart", "pie chart", "piechart", "histogram", "line chart", "bar graph", "pie diagram"]),
    ("graph", ["graph", "plot", "axes", "axis", "scatter", "throughput", "saturation", "curve", "vs load", "x y", "xy plot"]),
    ("table", ["table", "tabular", "burst time", "rows and columns", "rows", "columns", "spreadsheet", "gantt table"]),
    ("geometry", ["triangle", "pythagoras", "circle", "angle", "geometry", "geometric", "polygon", "theorem", "proof", "rectangle", "quadrilateral", "pentagon", "hexagon"]),
    ("network", ["network", "topology", "router", "switch", "uml", "class diagram", "sequence diagram", "er diagram", "entity relationship", "use case", "state machine", "data flow"]),
    ("timeline", ["timeline", "gantt", "roadmap", "chronology"]),
]

#: What descriptions of images and tables say, and the width of a table's cell.
SAYS = {
    "image": "Undescribed image ", "hash": " (content hash ", "bytes": " bytes; vision unavailable)", "figure": "Figure ", "nameless": "unnamed figure",
    "table": "Table with ", "headers": ". Headers: ", "blank": "(blank)", "first": " First row: ", "empty": "Empty table.",
}
CELL = 40


def tokens(text: Column, least: int = 1, stop: list[str] | None = None) -> Column:
    """X23. Lower-case ASCII letters and digits in runs; the study form drops short ones and stop words."""
    out = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+")
    out = F.array_remove(out, "") if least <= 1 else F.filter(out, lambda t: F.length(t) >= least)
    return F.array_except(out, F.array(*[F.lit(s) for s in stop])) if stop and least <= 1 else F.filter(out, lambda t: ~t.isin(stop)) if stop else out


def study_tokens(text: Column) -> Column:
    return tokens(text, 3, STUDY_STOP_WORDS)


def normalize(text: Column) -> Column:
    """X1. One kind of line end, single blanks, no blanks at line ends, at most one empty line, trimmed."""
    for pattern, to in ((r"\r\n?", "\n"), (r"[ \t]+", " "), (r" ?\n ?", "\n"), (r"\n{3,}", "\n\n"), (r"^[ \n]+|[ \n]+$", "")):
        text = F.regexp_replace(text, pattern, to)
    return text


def needs_ocr(text: Column, least: int = 20) -> Column:
    """X2."""
    return F.length(F.trim(F.coalesce(text, F.lit("")))) < least


def truncate(text: Column, n: int) -> Column:
    """X32. By characters, with an ellipsis where cut."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def safe_name(name: Column, most: int = 200) -> Column:
    """X24. The base name with safe characters; a long one keeps its extension."""
    base = F.element_at(F.split(F.regexp_replace(F.replace(F.coalesce(name, F.lit("")), F.lit("\\"), F.lit("/")), "/+$", ""), "/"), -1)
    safe = F.trim(F.regexp_replace(F.regexp_replace(base, "[^a-zA-Z0-9._ -]", "_"), r"^[ .]+", ""))
    ext = F.regexp_extract(safe, r"\.[^.]*$", 0)
    cut = F.concat(F.substring(safe, F.lit(1), F.greatest(F.lit(1), most - F.length(ext))), ext)
    return F.when(safe == "", "document.pdf").when(F.length(safe) > most, cut).otherwise(safe)


def redact(text: Column, most: int = 500) -> Column:
    """X25. Blanks collapsed, words that look like an email address masked, cut at ``most`` characters."""
    edge = "<>( ),;:.\"'"

    def word(w: Column) -> Column:
        core = F.btrim(w, F.lit(edge))
        at, dot = F.instr(core, "@"), F.length(core) - F.instr(F.reverse(core), ".") + 1
        email = (at > 1) & (F.contains(core, F.lit("."))) & (dot > at + 1) & (dot < F.length(core))
        place = F.instr(w, core)
        return F.when(email, F.concat(F.substring(w, F.lit(1), place - 1), F.lit("[redacted-email]"), F.substring(w, place + F.length(core), F.length(w)))).otherwise(w)

    words = F.split(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), " ")
    out = F.array_join(F.transform(words, word), " ")
    return F.when(F.length(out) > most, F.concat(F.substring(out, 1, most), F.lit("…[truncated]"))).otherwise(out)


def content_hash(text: Column) -> Column:
    """X27."""
    return F.sha2(text, 256)


def cache_key(subject: Column, text: Column) -> Column:
    """X28. 32 hex digits of the hash of subject, NUL and text."""
    return F.substring(F.sha2(F.concat(F.coalesce(subject, F.lit("")), F.lit("\x00"), F.coalesce(text, F.lit(""))), 256), 1, 32)


def embedding_input(subject: Column, topics: Column, text: Column) -> Column:
    """X26. Subject, topics as bullets in order, and the question."""
    bullets = F.array_join(F.transform(F.array_sort(topics), lambda t: F.concat(F.lit("- "), t)), "\n")
    return F.concat_ws("\n\n", F.when(F.trim(subject) != "", F.concat(F.lit("Subject: "), subject)), F.when(F.size(topics) > 0, F.concat(F.lit("Topics:\n"), bullets)), F.concat(F.lit("Question:\n"), text))


def figure_type(name: Column) -> Column:
    """X18, the strict table: unknown for the rest."""
    n, out = F.lower(F.trim(F.coalesce(name, F.lit("")))), F.lit("unknown")
    for kind, names in FIGURE_TYPES.items():
        out = F.when(n.isin(names), kind).otherwise(out)
    return out


def quiz_figure_type(name: Column) -> Column:
    """X18, the quiz table: other names stay."""
    n = F.translate(F.lower(F.trim(F.coalesce(name, F.lit("")))), "- ", "__")
    out = n
    for kind, names in QUIZ_FIGURE_TYPES.items():
        out = F.when(n.isin(names), kind).otherwise(out)
    return out


def diagram_kind(kind: Column, name: Column, description: Column) -> Column:
    """X17. The first rule with one of its words, or phrases, in type, name or description; else the type itself."""
    hay = F.trim(F.regexp_replace(F.lower(F.concat_ws(" ", kind, name, description)), "[^a-z0-9]+", " "))
    padded = F.concat(F.lit(" "), hay, F.lit(" "))
    given = F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    out = F.when(given.isin("", "unknown", "none", "n/a", "other"), "unknown").when(given.isin("diagram", "diagrams"), "general_diagram").otherwise(given)
    for rule, words in reversed(DIAGRAM_RULES):
        phrases = [F.contains(hay, F.lit(w)) if " " in w else F.contains(padded, F.lit(f" {w} ")) for w in words]
        hit = phrases[0]
        for p in phrases[1:]:
            hit = hit | p
        out = F.when(hit, rule).otherwise(out)
    return out


def image_description(name: Column, data: Column, given: Column) -> Column:
    """X22. The description given, else one of name, hash and size of the image's bytes."""
    n = F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit("unnamed"))
    raw = F.concat(F.concat(n, F.lit(":")).cast("binary"), F.coalesce(data, F.unhex(F.lit(""))))
    made = F.concat(F.lit(SAYS["image"]), n, F.lit(SAYS["hash"]), F.substring(F.sha2(raw, 256), 1, 8), F.lit(", "), F.coalesce(F.octet_length(data), F.lit(0)).cast("string"), F.lit(SAYS["bytes"]))
    return F.coalesce(F.nullif(F.trim(given), F.lit("")), made)


def image_text(name: Column, kind: Column, description: Column) -> Column:
    """X22. ``Figure name (type): description``, with what there is of type and description; a nameless one is ``unnamed figure``."""
    given = lambda x: F.nullif(F.trim(x), F.lit(""))
    return F.concat(F.lit(SAYS["figure"]), F.coalesce(given(name), F.lit(SAYS["nameless"])), F.coalesce(F.concat(F.lit(" ("), given(F.lower(kind)), F.lit(")")), F.lit("")), F.coalesce(F.concat(F.lit(": "), given(description)), F.lit("")))


def table_rows(text: Column) -> Column:
    """X19. Lines to cells, by pipe, else tab, else comma; rule rows and empty lines go."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: (F.trim(x) != "") & ~x.rlike(r"^[\s|:+=-]+$"))
    cells = lambda x: F.when(F.contains(x, F.lit("|")), F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|")).when(F.contains(x, F.lit("\t")), F.split(x, "\t")).otherwise(F.split(x, ","))
    return F.transform(lines, lambda x: F.transform(cells(x), lambda c: F.trim(c)))


def table_summary(rows: Column) -> Column:
    """X20. Size, header and first row of parsed rows, and how many more there are; cells cut at 40 characters."""
    many = lambda n, what: F.concat(n.cast("string"), F.lit(f" {what}"), F.when(n == 1, "").otherwise("s"))
    cell = lambda c: F.when(F.length(F.trim(c)) > CELL, F.concat(F.substring(F.trim(c), 1, CELL - 3), F.lit("..."))).otherwise(F.trim(c))
    row = lambda k, shown: F.array_join(F.transform(F.get(rows, F.lit(k)), shown), ", ")
    n, columns = F.size(rows), F.array_max(F.transform(rows, lambda r: F.size(r)))
    head = F.concat(F.lit(SAYS["table"]), many(n, "row"), F.lit(" x "), many(columns, "column"), F.lit(SAYS["headers"]), row(0, lambda c: F.when(F.trim(c) == "", SAYS["blank"]).otherwise(cell(c))), F.lit("."))
    first = F.when(n > 1, F.concat(F.lit(SAYS["first"]), row(1, cell), F.lit("."))).otherwise("")
    more = F.when(n > 2, F.concat(F.lit(" (+"), many(n - 2, "more row"), F.lit(".)"))).otherwise("")
    return F.when(F.coalesce(n, F.lit(0)) <= 0, SAYS["empty"]).otherwise(F.concat(head, first, more))


#: Fixed patterns: marked formulas in the order of the text, and what a line with an equals sign must have besides.
MATH_COMMANDS = "frac sqrt sum int lim infty alpha beta gamma delta theta lambda pi sigma omega times div leq geq neq approx partial nabla in notin forall exists"
MATH = r"\$\$[^$]+?\$\$|\$[^$\n]+?\$|\\\[.+?\\\]|\\\(.+?\\\)|\\begin\{[a-zA-Z*]+\}(?s:.+?)\\end\{[a-zA-Z*]+\}|\\(?:" + MATH_COMMANDS.replace(" ", "|") + r")(?:\{[^{}]*\}){0,2}"
MATH_HINT = r"[0-9\\^_+\-*/|<>]"
MATH_LINE_BYTES = 300
MATH_PAIRS = (r"\$\$", r"\$\$"), (r"\\\[", r"\\\]"), (r"\\\(", r"\\\)"), (r"\$", r"\$")


def normal_math(x: Column) -> Column:
    """X21. A formula without its environment and one pair of marks, blanks single."""
    blanks = F.lit(" \t\n\r\x0b\x0c")
    s = F.trim(x, blanks)
    inner = F.when(F.startswith(s, F.lit("\\begin")), F.nullif(F.trim(F.regexp_extract(s, r"(?s)^\\begin[^}]*\}(.*)\\end", 1), blanks), F.lit("")))
    s = F.coalesce(inner, s)
    bare = F.coalesce(*[F.when(s.rlike(f"(?s)^{a}.+{b}$"), F.regexp_extract(s, f"(?s)^{a}(.+){b}$", 1)) for a, b in MATH_PAIRS], s)
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def math_expressions(text: Column) -> Column:
    """X21. Marked formulas in order, then short lines with an equals sign and a digit or sign; each once by its normal form.

    A line isn't counted again if it holds a formula found before, or lies in one. Only lines that could be equations are compared.
    """
    blanks = F.lit(" \t\n\r\x0b\x0c")
    t = F.coalesce(text, F.lit(""))
    as_found = lambda x: F.struct(x.alias("x"), normal_math(x).alias("n"))
    marked = F.transform(F.regexp_extract_all(t, F.lit(MATH), F.lit(0)), lambda x: as_found(F.trim(x, blanks)))
    lines = F.transform(F.split(t, "\n"), lambda x: F.trim(x, blanks))
    lines = F.array_distinct(F.filter(lines, lambda x: F.contains(x, F.lit("=")) & x.rlike(MATH_HINT) & (F.octet_length(x) <= MATH_LINE_BYTES)))
    none = F.array().cast("array<struct<x:string,n:string>>")
    more = lambda known, x, skip: F.when((x["n"] == "") | F.exists(known, lambda k: k["n"] == x["n"]) | skip, known).otherwise(F.concat(known, F.array(x)))
    first = F.aggregate(marked, none, lambda known, x: more(known, x, F.lit(False)))
    inside = lambda known, x: F.exists(known, lambda k: F.contains(k["x"], x["x"]) | F.contains(x["x"], k["x"]))
    both = F.aggregate(F.transform(lines, as_found), first, lambda known, x: more(known, x, inside(known, x)))
    return F.transform(both, lambda k: k["x"])


def option_list(json: Column) -> Column:
    """X29. Options given as strings or as objects with text, label or option: the first four different ones, or none."""
    plain = F.from_json(json, "array<string>")
    objects = F.from_json(json, "array<struct<text:string,label:string,option:string>>")
    named = F.transform(objects, lambda o: F.coalesce(o["text"], o["label"], o["option"]))
    is_object = F.exists(plain, lambda x: F.ltrim(x).startswith("{"))
    chosen = F.filter(F.transform(F.when(is_object, named).otherwise(plain), lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != "")
    four = F.slice(F.array_distinct(chosen), 1, 4)
    return F.when(F.size(four) == 4, four).otherwise(F.array().cast("array<string>"))


def image_list(json: Column) -> Column:
    """X30. Images given as names or as objects with alias keys: array<struct<name, kind, description>>."""
    plain = F.from_json(json, "array<string>")
    objects = F.from_json(json, "array<struct<name:string,image:string,file:string,figure_type:string,type:string,description:string,caption:string>>")
    as_struct = lambda n, k, d: F.struct(n.alias("name"), quiz_figure_type(k).alias("kind"), d.alias("description"))
    named = F.transform(objects, lambda o: as_struct(F.coalesce(o["name"], o["image"], o["file"]), F.coalesce(o["figure_type"], o["type"]), F.coalesce(o["description"], o["caption"])))
    bare = F.transform(plain, lambda x: as_struct(x, F.lit(""), F.lit(None).cast("string")))
    return F.when(F.exists(plain, lambda x: F.ltrim(x).startswith("{")), named).otherwise(bare)


def clamp_labels(labels: Column, subject: Column, most: int = 10) -> Column:
    """X33. array<struct<topic, confidence, subject>>: confidence within 0 and 1, blank topics gone, at most ten, subject filled in."""
    kept = F.filter(labels, lambda x: F.trim(F.coalesce(x["topic"], F.lit(""))) != "")
    fixed = F.transform(kept, lambda x: F.struct(F.trim(x["topic"]).alias("topic"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x["confidence"])).alias("confidence"), F.coalesce(F.nullif(F.trim(x["subject"]), F.lit("")), subject).alias("subject")))
    return F.slice(fixed, 1, most)
