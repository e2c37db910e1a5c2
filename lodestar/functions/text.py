"""Text scalars: tokenisers, normalisers, word windows, prompts (Column to Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words of the three tokenisers, and the clause endings that make a need incomplete.
POLICY_STOP = """
a an the and or but if then than that this these those of in on at to for from by with
without within is are was were be been being do does did doing have has had having
we our us it its as into about over under between during after before more most other
some such no nor not only own same so too very can will just should now which who whom
what when where why how all any both each few many patients patient study studies
results conclusion conclusions background methods method objective purpose
""".split()
TRAINING_STOP = """
a about above after again against all also am an and any are as at be because
been before being below between both but by can cannot could did do does doing
down during each few for from further had has have having he her here hers him
his how i if in into is it its itself just me more most my no nor not now of
off on once only or other our out over own same she should so some such than
that the their them then there these they this those through to too under
until up very was we were what when where which while who whom why will with
you your study studies aim aims aimed objective objectives purpose goal
patients patient results result conclusion conclusions method methods
background introduction using used use showed shown show found find analysis
associated association may might data group groups
""".split()
ANNOTATION_STOP = """
a about above after again against all also am an and any are as at be because been
before being below between both but by can cannot could did do does doing down during
each few for from further had has have having he her here hers him his how
i if in into is it its itself just me more most my no nor not now of off on once
only or other our out over own same she should so some such than that the their
them then there these they this those through to too under until up very was we
were what when where which while who whom why will with you your
what's whats study studies patient patients evidence show shows shown report reports
""".split()
DANGLING = """
and or but with without to for in on of at by from as than then that which who
whom whose the a an is are was were be been being it its their his her our
between among during within versus vs compared while whether if not no nor
""".split()
POLICY_TOKEN, TRAINING_TOKEN, ANNOTATION_TOKEN, WORD = r"[a-z0-9][a-z0-9\-']+", r"[a-z0-9]+", r"[A-Za-z0-9][A-Za-z0-9\-]*", r"\S+"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def _without(tokens: Column, stop: list[str], least: int = 1) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(stop) & (F.length(t) >= least))  # a set of literals is hashed once


def policy_tokens(text: Column) -> Column:
    """Folded tokens of two or more characters, without stop words."""
    return _without(_all(F.lower(text), POLICY_TOKEN), POLICY_STOP)


def training_tokens(text: Column) -> Column:
    """Folded alphanumeric tokens of two or more characters, without stop words."""
    return _without(_all(F.lower(text), TRAINING_TOKEN), TRAINING_STOP, 2)


def annotation_terms(text: Column) -> Column:
    """The set of folded tokens of three or more characters, without stop words."""
    return F.array_distinct(_without(F.transform(_all(text, ANNOTATION_TOKEN), F.lower), ANNOTATION_STOP, 3))


def word_count(text: Column) -> Column:
    """Runs of characters that are no white space."""
    return F.size(_all(text, WORD)).cast("long")


def squash(text: Column) -> Column:
    """Each run of any white space becomes one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def title_norm(text: Column) -> Column:
    """Squashed, without blanks, dots and colons at the ends, in lower case."""
    return F.lower(F.regexp_replace(squash(text), r"^[ .:]+|[ .:]+$", ""))


def question_norm(text: Column) -> Column:
    """X11: lower case, everything else than letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "))


def window_starts(words: Column, size: int, overlap: int, least: int) -> Column:
    """Where windows begin: a short text is one window, the last one is long enough or dropped."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than the window")
    n, step = F.size(words), size - overlap
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.filter(starts, lambda s: (s == 0) | ((s - step + size < n) & (n - s >= least)))


def lead_summary(text: Column, most: int = 400) -> Column:
    """The first two sentences, cut at `most` characters with dots."""
    lead = F.array_join(F.slice(F.split(squash(text), r"(?<=[.!?])\s+"), 1, 2), " ")
    return F.when(F.length(lead) > most, F.concat(F.rtrim(F.substring(lead, 1, most - 3)), F.lit("..."))).otherwise(lead)


def embed_text(*parts: Column) -> Column:
    """The parts that are not blank, joined by bars."""
    return F.concat_ws(" | ", *[F.nullif(F.trim(p), F.lit("")) for p in parts])


def options_text(options: Column) -> Column:
    """`A) text` of each option, by letter."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(options)), lambda e: F.concat(e["key"], F.lit(") "), e["value"])), " ")


def fill(template: str, **values: Column) -> Column:
    """A prompt template with its {name} slots filled."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def retrieval_query(rationale: Column, question: Column) -> Column:
    """The rationale unless it is blank, else the question."""
    return F.coalesce(F.nullif(F.trim(rationale), F.lit("")), F.trim(question))


def good_noun_phrase(text: Column) -> Column:
    """Whether a phrase is whole: length, words, question marks, last word, brackets."""
    last = F.element_at(F.split(F.lower(text), " "), -1)
    balanced = F.regexp_count(text, F.lit(r"\(")) == F.regexp_count(text, F.lit(r"\)"))
    return F.length(text).between(15, 220) & ~F.contains(text, F.lit("?")) & (F.size(F.split(text, " ")) >= 4) & ~last.isin(DANGLING) & balanced


# Phrases that announce an answer letter, in order.
ANSWER_PHRASES = [
    r"(?:the\s+)?answer\s+is\s*:?\s*\(?\s*([A-Za-z])\s*[\)\.:,]",
    r"(?:the\s+)?answer\s+is\s*:?\s*\(?\s*([A-Za-z])\s*$",
    r"\banswer\s*:\s*\(?\s*([A-Za-z])\b",
    r"\boption\s*\(?\s*([A-Za-z])\s*\)?",
    r"^\s*\(?\s*([A-Za-z])\s*[\)\.]\s",
    r"\(\s*([A-Za-z])\s*\)",
]
LONE_LETTER = r"\b([A-Za-z])\b"


def choice(text: Column, options: Column | None = None, letters: str = "ABCDE") -> Column:
    """The answer letter: the last valid match of the first phrase that has one, then the last lone letter of an option, then the option whose text stands last.

    options: map of letter to text; without it the given letters are valid and no text is looked for. Null if nothing is found.
    """
    body = F.trim(text)
    valid = F.array(*map(F.lit, letters)) if options is None else F.transform(F.map_keys(options), F.upper)

    def last(pattern: str) -> Column:
        found = F.transform(F.regexp_extract_all(body, F.lit(pattern), F.lit(1)), F.upper)
        return F.try_element_at(F.filter(found, lambda x: F.array_contains(valid, x)), F.lit(-1))

    ways = [last("(?im)" + p) for p in ANSWER_PHRASES] + [last(LONE_LETTER)]
    if options is not None:
        low = F.lower(body)
        told = F.filter(F.map_entries(options), lambda e: (F.trim(e["value"]) != "") & F.contains(low, F.lower(F.trim(e["value"]))))
        ends = F.transform(told, lambda e: F.struct((F.length(low) - F.length(F.call_function("substring_index", low, F.lower(F.trim(e["value"])), F.lit(-1))) - F.length(F.trim(e["value"]))).alias("at"), e["key"].alias("letter")))
        ways.append(F.array_max(ends)["letter"])
    return F.coalesce(*ways)


# What states a document's objective.
OBJECTIVE_HEADER = r"(?i)\b(?:OBJECTIVES?|AIMS?|PURPOSE|GOAL)\s*[:.]\s*"
AIM_SENTENCE = (
    r"(?i)(?:\bwe\s+aim(?:ed)?\s+to\b|\bthis\s+(?:study|review|analysis|work|paper)\s+aim(?:ed|s)?\s+to\b"
    r"|\bthe\s+(?:aim|objective|purpose|goal)\s+of\s+(?:this|the)\s+(?:study|review|analysis|work|paper)\s+was\s+to\b)\s*"
)


def after(text: Column, pattern: str) -> Column:
    """What follows the first match of a pattern; null without one."""
    rest = F.regexp_extract(text, r"(?s)^.*?" + pattern.replace("(?i)", "(?i:", 1) + r")(.*)$", 1)
    return F.when(text.rlike(pattern), rest)


def information_need(title: Column, text: Column, first_sentence) -> tuple[Column, Column]:
    """The need that a document states and how: a title that is a question, else the noun phrase of its objective.

    first_sentence: the sentence splitter's first part, as a function of a column.
    """
    asked = squash(F.coalesce(title, F.lit("")))
    question = F.when(asked.endswith("?") & F.length(asked).between(15, 220), asked)
    header, aim = after(text, OBJECTIVE_HEADER), after(text, AIM_SENTENCE)
    aimed = first_sentence(aim)
    stated = F.when(header.isNotNull(), first_sentence(header)).otherwise(F.when(F.startswith(F.lower(aimed), F.lit("to ")), aimed).otherwise(F.concat(F.lit("to "), aimed)))
    phrase = F.regexp_extract(F.rtrim(F.trim(stated), F.lit(".")), r"(?i)^to\s+[a-z]+\s+(.{15,220})$", 1)
    need = F.trim(F.rtrim(squash(phrase), F.lit(".;:,")))
    good = F.when(good_noun_phrase(need), need)
    return F.coalesce(question, good), F.when(question.isNotNull(), "title_question").when(good.isNotNull(), "objective_np")
