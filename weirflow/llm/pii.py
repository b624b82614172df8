"""Personal data by candidate gradient boosting, in DataFrame and SQL functions throughout.

Base patterns find e-mail and IP addresses, card and telephone numbers; what they find stays. Several generators for each
kind, with a high recall, propose further spans, overlapping ones too: addresses written out or spaced, defanged
and dashed numbers, other separators, national forms, IPv6. Boosted trees judge those by their form and by the text around
them, a curve calibrated on examples held back turns margins into probabilities, and a threshold for each kind keeps
a precision of ``PRECISION`` on them. Of accepted spans that overlap, the first stays.

The trees are fitted on labelled examples: what the base patterns find in the documents, with the text around it, written
in other forms (valid finds are examples of personal data, failing ones are not), those candidates that the generators propose
in the documents as they are and that a check of their kind refutes (``REFUTED``: not personal, whatever they look like), and sentences from templates. Candidates that no check
refutes can be personal data in disguise; they have no label and teach nothing, so what is found does not hang on how much of it the table holds. A fourth of the finds and
one form of each kind are held back from the trees and serve the curve and the thresholds. All documents are read,
and only counts of distinct feature vectors come to the driver, at most 2 ** len(FEATURES) of them and in practice hundreds.

No text is shuffled and no row goes to Python. Defined results: a null text is empty and has no spans;
positions are code points, ends excluded; each input row gives one row, repeated rows give equal rows; columns besides the two named ones are
ignored by ``spans`` and kept by ``redact``; an empty table gives an empty result, and the trees then know the templates only; a kind without
examples that reach the precision accepts nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm import boosting
from weirflow.llm.arrow import keyed_text

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.98
EXAMPLES = 6000
#: Matches whose positions are summed one by one; between them running sums are kept.
STRIDE = 64

# The base patterns, in a form that takes the same matches without backtracking over long runs. A
# match can only begin where its first run does, or where the match before it ended.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold before a pattern is tried.
GUARD = {"email": r"@", "ip": r"[0-9]\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
#: What a text with any match of any pattern holds: a digit, the sign, or "at" that no letter or digit touches.
SOME = "text rlike '[0-9@]|(?:at|AT)(?![A-Za-z0-9])(?<![A-Za-z0-9]..)'"
DIGITS = "regexp_replace(x.match, '[^0-9]', '')"
#: A number up to 255, and the numbers of a match between spaces.
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
QUADS = "trim(regexp_replace(x.match, '[^0-9]+', ' '))"
VALID = {
    "email": "true",
    "ip": r"x.match rlike '^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(?:\\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])){3}$'",
    "card": f"length({DIGITS}) between 12 and 19 and luhn_check({DIGITS})",
    "phone": f"length({DIGITS}) between 9 and 15",
}
#: What shows that a candidate x is none of its kind: a last label that is no top-level domain, numbers that are no address, a wrong check digit, or digits too few, too many or going on beyond it.
REFUTED = {
    "email": r"not x.match rlike '(?i)(?:\\.|dot[\\])}]? ?|[_-]dot[_-]|\\. {0,2})(?:com|org|net|edu|gov|io|info|eu|[a-z]{2})$'",
    "ip": rf"not ({QUADS} rlike '^{BYTE}(?: {BYTE}){{3}}$' or x.match like '%::%' or size(split(x.match, ':')) = 8)",
    "card": f"not (length({DIGITS}) between 12 and 19 and luhn_check({DIGITS}))",
    "phone": rf"not length({DIGITS}) between 9 and 15 or x.after rlike '^[\\x20./_-]?[0-9]' or x.before rlike '[0-9][\\x20./_-]?$'",
}
NAME, LABEL, SEP = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}", r"[A-Za-z0-9-]{1,63}", r"[\x20./_-]{1,2}"
GENERATORS = {
    "email": (
        NAME + r"\x20?(?:[\[({]\x20?(?:at|AT|@)\x20?[\])}]|\x20(?:at|AT)\x20)\x20?" + LABEL + r"(?:(?:\x20?[\[({]\x20?(?:dot|DOT|\.)\x20?[\])}]\x20?|\x20(?:dot|DOT)\x20|\.)" + LABEL + "){1,4}",
        NAME + r"\x20{0,2}@\x20{1,2}" + LABEL + r"(?:\x20{0,2}\.\x20{0,2}" + LABEL + "){1,4}",
        NAME + r"\x20{1,2}@\x20{0,2}" + LABEL + r"(?:\x20{0,2}\.\x20{0,2}" + LABEL + "){1,4}",
        r"(?<![A-Za-z0-9])[A-Za-z0-9]{1,64}[_-](?:at|AT)[_-][A-Za-z0-9]{1,63}(?:[_-](?:dot|DOT)[_-][A-Za-z0-9]{1,63}){1,4}",
    ),
    "ip": (
        r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Fa-f:])",
        r"(?<![0-9.])[0-9]{1,3}(?:\x20?(?:[\[({](?:\.|dot|DOT)[\])}]|\x20(?:dot|DOT)\x20)\x20?[0-9]{1,3}){3}(?![0-9])",
        r"(?<![0-9.])[0-9]{1,3}(?:\x20?[.]\x20[0-9]{1,3}|\x20[.]\x20?[0-9]{1,3}){3}(?![0-9])",
        r"(?<![0-9-])[0-9]{1,3}(?:-[0-9]{1,3}){3}(?![0-9-])",
    ),
    "card": (
        r"(?<![0-9])[0-9]{4}(?:" + SEP + "[0-9]{4}){2}" + SEP + "[0-9]{3,7}(?![0-9])",
        r"(?<![0-9])3[47][0-9]{2}" + SEP + "[0-9]{6}" + SEP + "[0-9]{5}(?![0-9])",
        r"(?<![0-9])[0-9]{4}(?:[\x20|:;,*]{1,3}[0-9]{4}){3}(?![0-9])",
    ),
    "phone": (
        r"(?<![0-9+])(?:00[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20./-])[0-9]{3,4}[\x20./-]?[0-9]{3,4}(?![\x20./-]?[0-9])",
        r"(?<![0-9+])00[0-9]{1,3}(?:[\x20./_-]?\(?[0-9]{2,4}\)?){2,5}(?![0-9])",
        r"\+[0-9]{1,3}(?:" + SEP + r"\(?[0-9]{2,4}\)?){2,5}(?![0-9])",
    ),
}
# What every match of a kind's generators holds, tried once for all of them; for e-mail a written-out or spaced sign, and behind a bare "at" a name with a dot.
GENERATOR_GUARD = {"email": r"(?=[\x20@\[({_-])(?:@\x20|\x20@|[\[({]\x20?(?:at|AT|@)\x20?[\])}]|[_-](?:at|AT)[_-]|\x20(?:at|AT)\x20{1,2}[A-Za-z0-9-]{1,63}(?:\x20?[\[({]|\x20(?:dot|DOT)\x20|\.[A-Za-z0-9-]))", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:|[0-9][\x20\[({]{0,2}(?:[.-]|dot|DOT)[\x20\])}]{0,2}[0-9]{1,3}[\x20\[({]{0,2}(?:[.-]|dot|DOT)[\x20\])}]{0,2}[0-9]", "card": r"[0-9]{4}[\x20./_|:;,*-]{1,3}[0-9]{4}", "phone": r"[0-9]{2}\)?[\x20./_-]{1,2}\(?[0-9]{2}|00[0-9]{8}"}

#: Other forms of what the base patterns find, as SQL of x.match; the last of each kind is held back from the trees.
FORMS = {
    "email": ("replace(replace(x.match, '@', ' at '), '.', ' dot ')", "replace(replace(x.match, '@', ' [at] '), '.', ' [dot] ')", "replace(x.match, '@', ' (at) ')", "replace(x.match, '@', ' @ ')", "replace(replace(x.match, '@', ' AT '), '.', ' DOT ')", "replace(replace(x.match, '@', '{at}'), '.', '{dot}')"),
    "ip": ("replace(x.match, '.', '[.]')", "replace(x.match, '.', ' . ')", "replace(x.match, '.', '(dot)')", "replace(x.match, '.', '-')", "replace(x.match, '.', ' dot ')"),
    "card": tuple(f"regexp_replace(regexp_replace(x.match, '[^0-9]', ''), '([0-9]{{4}})(?=[0-9]{{3}})', '$1{sep}')" for sep in (".", "/", "_", "  ")),
    "phone": ("regexp_replace(x.match, '^[+]', '00')", "regexp_replace(x.match, '^[+][0-9]{1,3}[^0-9(]*', '')", "regexp_replace(regexp_replace(x.match, '^[+][0-9]{1,3}[^0-9(]*', ''), '[^0-9()]+', '.')", "regexp_replace(x.match, '[^0-9+()]+', '/')"),
}

#: Features by name, SQL of a candidate x (match, before, after).
FEATURES = {
    **{f"is_{k}": f"x.kind = {i}" for i, k in enumerate(KINDS)},
    "says_phone": r"x.before rlike '(?i)\\b(?:call|phone|tel|telephone|mobile|cell|fax|reach|dial|ring)\\b[^.]*$'",
    "says_mail": r"x.before rlike '(?i)\\b(?:e-?mail|mail|write|contact|reach)\\b[^.]*$'",
    "says_card": r"x.before rlike '(?i)\\b(?:card|visa|mastercard|amex|credit|debit|paid)\\b[^.]*$'",
    "says_ip": r"x.before rlike '(?i)\\b(?:ip|ipv6|address|host|server|from)\\b[^.]*$'",
    "says_other": r"x.before rlike '(?i)\\b(?:order|version|serial|invoice|ref|total|sum|isbn|page|ratio|time|build|part|item|look|looked|arrived|meet|score|case)\\b[^.]*$'",
    "touches_before": "x.before rlike '[A-Za-z0-9_#=/$-]$'",
    "touches_after": "x.after rlike '^[A-Za-z0-9_%/=-]'",
    "brackets": r"x.match rlike '^\\([0-9]+\\)'",
    "bracketed_at": r"x.match rlike '(?i)[\\[({] ?at ?[\\])}]'",
    "spelled_dot": r"x.match rlike '(?i)(?: dot |[\\[({] ?dot ?[\\])}])'",
    "top_domain": r"x.match rlike '(?i)(?:\\.|dot[\\])}]? ?)(?:com|org|net|edu|gov|io|de|fr|es|uk|info|eu)$'",
    "ten_digits": f"length({DIGITS}) = 10",
    "more_digits": f"length({DIGITS}) > 10",
    "luhn": f"luhn_check({DIGITS})",
    "eight_groups": "size(split(x.match, ':')) = 8",
    "double_colon": "x.match like '%::%'",
    "long_group": "x.match rlike '[0-9A-Fa-f]{3,4}:'",
    "points_only": r"x.match rlike '^[0-9]+(?:\\.[0-9]+)+$'",
    "slashes": r"x.match rlike '[/_|;,*]'",
    "dashes": r"x.match rlike '^[0-9]+(?:-[0-9]+)+$'",
    "four_bytes": rf"{QUADS} rlike '^{BYTE}(?: {BYTE}){{3}}$'",
    "spaced_at": "x.match like '% @%' or x.match like '%@ %'",
    "starts_00": "x.match like '00%'",
    "plus": "x.match like '+%'",
    "goes_on": r"x.after rlike '^[\\x20./_-]?[0-9]'",
    "comes_from": r"x.before rlike '[0-9][\\x20./_-]?$'",
    "colon_before": r"x.before rlike '[:=]\\s*[\\[(<]?$'",
    "base_before": r"x.before rlike '@[A-Za-z0-9-]+\\.|[+][0-9]'",
}

#: Labelled examples: # is a digit, ~ the span that a generator should propose; + those that are personal, - those that are not.
TEMPLATES = {
    "email": "+write to ann##~ (at) mail# dot example dot com soon|+mail: jo.smith##~ [at] host#.org|+contact ann_## at example## dot com|+my e-mail is k##{at}web#{dot}net|+reach me: b.lee## AT corp#.com|"
    "-we looked at example##.txt yesterday|-arrived at gate##.it was late|-meet at noon.then go|-the ratio at step#.end|-look at page##.html|-he sat at home.she left",
    "ip": "+host 2001:db8:##:#:aa:b#:c##:#f is up|+from fe80::1##:ab##:cd#f|+ip 2a0#:6b8::##:#f0|+server address 2001:0db8:85a3:0000:0000:8a2e:0370:####|-at time 1#:2#:4# we met|-ratio 3:4:##|-score 1#:2#:3#|-time ##:##:##|-build ab:##:cd|-case 1:2:3:##",
    "card": "+card ####.####.####.####|+paid by visa ####/####/####/####|+my credit card ####_####_####_####|+debit ####  ####  ####  ####|-serial ####.####.####.####|-part ####/####/####/####|-order ####_####_####_####|-item ####-####-####-####|-ref ####.####.####.#####|-then ####.####.####.#### and|-so ####/####/####/#### it|-total ####.####.####.###",
    "phone": "+call me on ###-###-#### today|+tel: (###) ###-####|+phone ###.###.####|+my mobile is ### ### ####|+fax ###/###-####|+dial 0049 ### #### ####|+reach us at (###) ###-####|-order ###-###-#### came|-version ###.###.####|-isbn ###-####-###|-sum ### ### ####|-part ###/###/####|-invoice ###-###-####|-serial ###.####.####|-page ##/###-###|-total ## #### ####|-then ####.####.####.#### and|-a ###.###.### b|-so ####-####-#### it|-and ####/####/####/#### so|-we ### ### ### ###",
}


def let(value: str, name: str, body: str) -> str:
    """SQL that computes ``value`` once and calls it ``name`` in ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def literal(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


SPAN = "array<struct<start: bigint, kind: int, end: bigint, match: string, before: string, after: string>>"


def matches(text: str, pattern: str, guard: str, kind: int) -> str:
    """SQL for all matches with their places and surroundings; the guard keeps other texts from being cut up."""
    return guarded(text, guard, cut(text, pattern, kind))


def guarded(text: str, guard: str, found: str) -> str:
    return f"case when {text} rlike {literal(guard)} then {found} else cast(array() as {SPAN}) end"


def cut(text: str, pattern: str, kind: int) -> str:
    """SQL for all matches with their places and surroundings."""
    rx = literal(pattern)
    start = f"o[i div {STRIDE}] + aggregate(slice(w, (i div {STRIDE}) * {STRIDE} + 1, i % {STRIDE}), 0L, (a, y) -> a + y) + length(s.p[i])"
    each = let(start, "b", f"named_struct('start', b, 'kind', {kind}, 'end', b + length(x), 'match', x, 'before', right(s.p[i], 40), 'after', left(s.p[i + 1], 2))")
    sums = f"aggregate(sequence(1, (size(w) - 1) div {STRIDE} + 1), array(0L), (a, k) -> concat(a, array(element_at(a, -1) + aggregate(slice(w, (k - 1) * {STRIDE} + 1, {STRIDE}), 0L, (c, y) -> c + y))))"
    body = let("transform(s.m, (x, i) -> cast(length(s.p[i]) + length(x) as bigint))", "w", let(sums, "o", f"transform(s.m, (x, i) -> {each})"))
    return let(f"named_struct('m', regexp_extract_all({text}, {rx}, 0), 'p', split({text}, {rx}, -1))", "s", f"if(size(s.m) = 0, cast(array() as {SPAN}), {body})")


def running_max(values: str, least: str = "0L") -> str:
    """SQL for the greatest of the values before each place (``least`` at the first), in steps of STRIDE values."""
    sums = f"aggregate(sequence(0, greatest((size(w) - 1) div {STRIDE}, 0)), array({least}), (a, k) -> concat(a, array(greatest(element_at(a, -1), coalesce(array_max(slice(w, k * {STRIDE} + 1, {STRIDE})), {least})))))"
    each = f"transform(w, (x, i) -> greatest(m[i div {STRIDE}], coalesce(array_max(slice(w, (i div {STRIDE}) * {STRIDE} + 1, i % {STRIDE})), {least})))"
    return let(values, "w", let(sums, "m", each))


@dataclass(frozen=True)
class Model:
    trees: list[boosting.Tree]
    slope: float
    bias: float
    thresholds: tuple[float, ...]

    def sql(self, x: str) -> str:
        """Whether a candidate with the features ``x`` is accepted."""
        total = " + ".join(t.sql(x) for t in self.trees)
        least = " ".join(f"when {x}[{i}] = 1 then {t:.9f}D" for i, t in enumerate(self.thresholds))
        return f"1 / (1 + exp(-({self.slope:.9f}D * ({total}) + {self.bias:.9f}D))) >= case {least} end"


def features(x: str = "x") -> str:
    return "array(" + ", ".join(f"if({f}, 1, 0)" for f in FEATURES.values()) + ")"


def example_rows(spark: SparkSession) -> DataFrame:
    """kind, label, held and text of the labelled examples."""
    cases = [(kind, t[0] == "+", t[1:].replace("~", "")) for kind, all_ in enumerate(TEMPLATES.values()) for t in all_.split("|")]
    table = ", ".join(f"named_struct('kind', {kind}, 'label', {int(label)}, 'text', {literal(text)})" for kind, label, text in cases)
    filled = "array_join(transform(split(e.text, ''), (c, k) -> if(c = '#', cast(pmod(xxhash64(id, k), 10) as string), c)), '')"
    rows = spark.range(EXAMPLES).selectExpr("id", f"element_at(array({table}), cast(pmod(id, {len(cases)}) as int) + 1) as e")
    return rows.selectExpr("e.kind", "e.label", f"pmod(id div {len(cases)}, 4) = 3 as held", f"{filled} as text")


def proposed(kind: int) -> str:
    """SQL for the candidates of all generators of a kind in ``text``."""
    name = KINDS[kind]
    return guarded("text", GENERATOR_GUARD[name], "concat(" + ", ".join(cut("text", g, kind) for g in GENERATORS[name]) + ")")


def document_rows(docs: DataFrame) -> DataFrame:
    """label, held and f (features) of what the documents themselves teach."""
    every = []
    for i, k in enumerate(KINDS):
        x = f"named_struct('kind', x.kind, 'match', {{}}, 'before', x.before, 'after', x.after)"
        fits = literal("^(?:" + "|".join(GENERATORS[k]) + ")$")
        forms = ", ".join(f"named_struct('x', {x.format(f)}, 'label', if({VALID[k]}, 1, 0), 'held', {str(n + 1 == len(FORMS[k])).lower()} or pmod(xxhash64(x.match), 4) = 3)" for n, f in enumerate(FORMS[k]))
        every.append(f"filter(flatten(transform({matches('text', BASE[k], GUARD[k], i)}, x -> array({forms}))), y -> y.x.match rlike {fits})")
        natural = f"filter({proposed(i)}, x -> not x.match rlike {literal(BASE[k])} and ({REFUTED[k]}))"
        every.append(f"transform({natural}, x -> named_struct('x', {x.format('x.match')}, 'label', 0, 'held', pmod(xxhash64(x.match), 4) = 3))")
    return docs.where(SOME).selectExpr(f"explode(concat({', '.join(every)})) as e").selectExpr("e.label", "e.held", f"element_at(transform(array(e.x), x -> {features()}), 1) as f")


def fit(spark: SparkSession, docs: DataFrame | None = None) -> Model:
    """Trees, curve and thresholds from the labelled examples of templates and, if they are given, of documents (column ``text``)."""
    kinds = " ".join(f"when kind = {i} then {proposed(i)}" for i in range(len(KINDS)))
    found = example_rows(spark).selectExpr("label", "held", f"explode(transform(case {kinds} end, x -> {features()})) as f")
    if docs is not None:
        found = found.unionByName(document_rows(docs.select(F.col("text").cast("string").alias("text"))))
    counted = found.groupBy("held", "f").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("q")).collect()
    rows = sorted((tuple(r["f"]), float(r["p"]), float(r["q"]), r["held"]) for r in counted)
    trees = boosting.fit([r[:3] for r in rows if not r[3]])
    back = [(boosting.margin(trees, x), p, q, x) for x, p, q, held in rows if held]
    slope, bias = boosting.calibrate([b[:3] for b in back])
    limits = tuple(boosting.threshold([(boosting.sigmoid(slope * m + bias), p, q) for m, p, q, x in back if x[k]], PRECISION) for k in range(len(KINDS)))
    return Model(trees, slope, bias, limits)


def spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, base and found: arrays of (start, kind, end), kinds by number, sorted; ``found`` holds the base spans too."""
    bare = "transform({}, x -> named_struct('start', x.start, 'kind', x.kind, 'end', x.end))"
    base = "concat(" + ", ".join(f"filter({matches('text', BASE[k], GUARD[k], i)}, x -> {VALID[k]})" for i, k in enumerate(KINDS)) + ")"
    more = "concat(" + ", ".join(f"filter({proposed(i)}, x -> {let(features(), 'f', model.sql('f'))})" for i in range(len(KINDS))) + ")"
    empty = f"cast(array() as {SPAN})"
    rows = keyed_text(docs, id_col, text_col).selectExpr("doc_id", "text", f"case when {SOME} then {base} else {empty} end as base", f"case when {SOME} then {more} else {empty} end as more")
    rows = rows.selectExpr("doc_id", "text", f"array_sort({bare.format('base')}) as base", f"array_sort({bare.format('more')}) as more")
    # all spans in a row, base ones (0) before others (1) that begin where they do
    row = "array_sort(concat(transform(base, x -> named_struct('start', x.start, 'more', 0, 'kind', x.kind, 'end', x.end)), transform(more, x -> named_struct('start', x.start, 'more', 1, 'kind', x.kind, 'end', x.end))))"
    behind = running_max("transform(r, x -> if(x.more = 0, x.end, 0L))")
    ahead = f"reverse({running_max('reverse(transform(r, x -> if(x.more = 0, -x.start, -9223372036854775807L)))', '-9223372036854775807L')})"
    others = running_max("transform(r, x -> if(x.more = 1, x.end, 0L))")
    free = let(behind, "b", let(ahead, "a", let(others, "o", "filter(r, (x, i) -> x.more = 0 or (b[i] <= x.start and -a[i] >= x.end and o[i] <= x.start))")))
    merged = let(row, "r", bare.format(free))
    return rows.selectExpr("doc_id", "text", "base", f"if(size(more) = 0, base, {merged}) as found")


def listed(column: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({column}, x -> concat({names}[x.kind], ':', x.start, ':', x.end)), ',')"


def digest(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The columns of the query."""
    found = spans(docs, model or fit(docs.sparkSession, docs))
    counts = [f"cast(size(filter(base, x -> x.kind = {i})) as bigint) as n_{k}" for i, k in enumerate(KINDS)]
    return found.selectExpr("doc_id", *counts, f"sha2({listed('base')}, 256) as base_sha256", f"{listed('found')} as spans")


def redact(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each span, overlapping ones as one, replaced by the name of its first kind in angle brackets. Texts without spans, null ones among them, stay as they are."""
    wide = docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("_text"))
    found = spans(wide.withColumnRenamed("_text", "text"), model or fit(docs.sparkSession, docs.select(F.col(text_col).cast("string").alias("text"))), "_row", "text").withColumnRenamed("doc_id", "_row")
    names = "array(" + ", ".join(f"'<{k.upper()}>'" for k in KINDS) + ")"
    # m is the end of what the spans before cover; a span that begins within it is part of it
    parts = f"transform(found, (x, i) -> if(x.start < m[i], '', concat(substring(text, cast(m[i] + 1 as int), cast(x.start - m[i] as int)), {names}[x.kind])))"
    rest = "substring(text, cast(array_max(transform(found, x -> x.end)) + 1 as int))"
    clean = let(running_max("transform(found, x -> x.end)"), "m", f"concat(array_join({parts}, ''), {rest})")
    rows = found.selectExpr("_row", f"if(size(found) = 0, _row.`{text_col}`, {clean}) as _clean")
    return rows.select(*[F.col("_clean").alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns])
