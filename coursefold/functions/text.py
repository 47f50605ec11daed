"""Text, state and time rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States in the order in which a chapter passes through them.
STATES = ["not-started", "planned", "taught", "checked"]


def chapter_state(checks: Column, done: Column, count: Column) -> Column:
    """No concept count at all means that there is no progress row."""
    return F.when(count.isNull(), "not-started").when(checks > 0, "checked").when((count > 0) & (done >= count), "taught").otherwise("planned")


def state_rank(state: Column) -> Column:
    return (F.array_position(F.array(*map(F.lit, STATES)), state) - 1).cast("int")


def contains_ignoring_case(column: Column, search: str) -> Column:
    """The trimmed search text anywhere in the column; none matches all, over 64 characters is an error."""
    search = search.strip()
    if len(search) > 64:
        raise ValueError("search text over 64 characters")
    return F.lower(column).contains(search.lower()) if search else F.lit(True)


#: What counts as white space in a text field, beside the ASCII ones a no-break space, a byte order mark and others.
SPACES = "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def trimmed(column: Column) -> Column:
    return F.trim(column, F.lit(SPACES))


def words(column: Column) -> Column:
    """What stands between white space."""
    return F.filter(F.split(F.translate(column, SPACES, " " * len(SPACES)), " "), lambda w: w != "")


def units(column: Column) -> Column:
    """The length that a text field counts: a character past U+FFFF counts as two."""
    return F.length(column) + F.regexp_count(column, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def matches_words(query: Column, keywords: Column) -> Column:
    words_ = words(F.lower(query))
    return F.forall(words_, lambda w: keywords.contains(w))


def no_controls(column: Column) -> Column:
    return column.rlike(r"\A[^\p{C}]+\z")


def six_digits(column: Column) -> Column:
    return column.rlike(r"\A[0-9]{6}\z")


def valid_region(text: Column) -> Column:
    """1 to 60 characters, not all blank, none of them a control, format or unassigned one."""
    return (trimmed(text) != "") & (units(text) <= 60) & no_controls(text)


def valid_name(text: Column) -> Column:
    return valid_region(text)  # the same rule


def valid_school(text: Column) -> Column:
    """Up to 100 characters; none at all is fine."""
    return (units(text) <= 100) & ~text.rlike(r"\p{C}")


def birth_years(year: Column) -> Column:
    """The years in which a child of 3 to 18 was born, newest first."""
    return F.sequence(year - 3, year - 18, F.lit(-1))


def class_choices(board: Column) -> Column:
    return F.sequence(F.lit(1), F.when(board == "cbse", 10).otherwise(5))


def touched(draft: Column) -> Column:
    """Whether anything was entered in a draft (name, class_level, birth_year, school)."""
    return (trimmed(draft["name"]) != "") | draft["class_level"].isNotNull() | (draft["birth_year"] != "") | (trimmed(draft["school"]) != "")


def complete(draft: Column, board: Column, year: Column) -> Column:
    years = F.transform(birth_years(year), lambda y: y.cast("string"))
    classed = F.coalesce(F.array_contains(class_choices(board), draft["class_level"]), F.lit(False))
    return valid_name(draft["name"]) & classed & F.array_contains(years, draft["birth_year"]) & valid_school(draft["school"])


def blocking_draft(drafts: Column, board: Column, year: Column) -> Column:
    """The place, from 0, of the first draft that was started and not finished, or null."""
    blocks = F.transform(drafts, lambda d: touched(d) & ~complete(d, board, year))
    return F.nullif(F.array_position(blocks, F.lit(True)), F.lit(0)) - 1


def first_and_touched(drafts: Column) -> Column:
    return F.filter(drafts, lambda d, i: (i == 0) | touched(d))


def is_kebab(column: Column) -> Column:
    return column.rlike(r"\A[a-z0-9]+(-[a-z0-9]+)*\z")


def class_available(board: Column, class_level: Column) -> Column:
    return class_level.between(1, 10) & ((board == "cbse") | (class_level <= 5))


#: Fixed value: the id of no family.
NO_ID = "00000000-0000-0000-0000-000000000000"


def reject_reason(consent: Column, board_known: Column, family_id: Column, board: Column, classes: Column) -> Column:
    """Why a registration is refused, the first that holds in this order; null if none does. ``classes``: a list, one for each child."""
    no_id = F.coalesce(family_id == NO_ID, F.lit(True))
    no_class = F.exists(classes, lambda level: ~F.coalesce(class_available(board, level), F.lit(False)))
    return F.when(~F.coalesce(consent, F.lit(False)), "consent").when(~F.coalesce(board_known, F.lit(False)), "board").when(no_id, "family-id").when(no_class, "class")


def registered_texts(region: Column, notice: Column) -> tuple[Column, Column]:
    """Region and notice version as a registration keeps them: without white space around."""
    return trimmed(region), trimmed(notice)


def backoff_seconds(failures: Column) -> Column:
    return F.when(failures < 1, 0.0).otherwise(F.least(5 * F.pow(F.lit(2.0), F.least(failures - 1, F.lit(16))), F.lit(300.0)))


def seconds_left(until: Column, now: Column) -> Column:
    return F.greatest(F.ceil((F.unix_millis(until) - F.unix_millis(now)) / 1000), F.lit(0))


def day_part(ts: Column) -> Column:
    return F.when(F.hour(ts) < 12, "morning").when(F.hour(ts) < 17, "afternoon").otherwise("evening")


def first_word(name: Column) -> Column:
    """The first of a name's words; of a blank name the empty text."""
    return F.coalesce(F.get(words(name), 0), F.when(name.isNotNull(), ""))


def initial(name: Column) -> Column:
    """The first character as it stands, in upper case; a blank before a name is not skipped."""
    return F.upper(F.substring(name, 1, 1))


def short_date(ts: Column) -> Column:
    return F.date_format(ts, "d MMM")


def state_line(state: Column, attempts: Column, done: Column, count: Column) -> Column:
    """The state, the attempt if it is not the first, and progress while planned."""
    return F.concat_ws(" · ", state, F.when(attempts > 1, F.concat(F.lit("attempt "), attempts.cast("string"))), F.when(state == "planned", F.concat(done.cast("string"), F.lit(" of "), count.cast("string"))))


def name_list(names: Column) -> Column:
    """``A, B and C``."""
    head = F.array_join(F.slice(names, 1, F.greatest(F.size(names) - 1, F.lit(0))), ", ")
    return F.when(F.size(names) < 2, F.array_join(names, "")).otherwise(F.concat(head, F.lit(" and "), F.element_at(names, -1)))


def code_digits(text: Column) -> Column:
    return F.substring(F.regexp_replace(text, r"\D", ""), 1, 6)


def recovery_groups(code: Column) -> Column:
    return F.regexp_replace(F.upper(F.regexp_replace(code, r"[\s-]", "")), "(.{4})(?=.)", "$1-")


def listed_or(value: Column, allowed: list[str], default: str) -> Column:
    return F.when(value.isin(allowed), value).otherwise(default)


def split_list(column: Column) -> Column:
    return F.filter(F.split(column, ","), lambda x: x != "")


def looked_up(code: Column, known: dict[str, str], default: str | None = None) -> Column:
    """The entry of a small closed list, or the default."""
    entries = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    return F.coalesce(entries[code], F.lit(default).cast("string"))


#: Reasons that a client shows for a failed request's code, and the HTTP status of each code.
REASONS = {
    "code-wrong": "wrongCode", "code-expired": "codeExpired", "proof-required": "codeExpired", "code-attempts-used": "tooManyTries", "code-too-soon": "tooSoon",
    "email-not-verified": "emailNotVerified", "email-not-sent": "emailNotSent", "network": "unreachable", "timeout": "unreachable",
}
STATUS = {
    "already-registered": 409, "not-registered": 404, "invalid-registration": 400, "caller-not-identified": 401, "child-not-found": 404, "family-not-found": 404,
    "chapter-not-found": 404, "invalid-search": 400, "subject-not-found": 404, "child-limit-reached": 409, "child-deleting": 409, "family-id-taken": 409,
    "class-not-available": 400, "content-not-ready": 409, "invalid-page": 400, "code-wrong": 400, "code-too-soon": 429, "code-attempts-used": 429,
    "code-expired": 410, "proof-required": 403, "email-not-sent": 502, "email-not-verified": 403, "family-changed": 409,
}


def http_status(code: Column) -> Column:
    """The status of a failure's code; a code without one is an error, as the list is closed."""
    known = F.create_map(*(F.lit(x) for pair in STATUS.items() for x in pair))[code]
    return F.coalesce(known, F.raise_error(F.concat(F.lit("no status for "), F.coalesce(code, F.lit("null")))).cast("int"))


def described(failures: DataFrame, problems: DataFrame, code: str = "code") -> DataFrame:
    """Failures with title and detail from a small table of ``problems``, one row a code, and their status."""
    return failures.join(problems, code, "left").withColumn("status", http_status(F.col(code)))


def substituted(text: Column, values: dict[str, Column]) -> Column:
    """JSON text in which each string that is just ``{{name}}`` is the value of that name, as JSON."""
    for name, value in values.items():
        text = F.replace(text, F.lit(f'"{{{{{name}}}}}"'), value.cast("string"))
    return text


def canonical_json(text: Column) -> Column:
    """The same for texts of equal JSON values: no blanks, keys sorted at every level."""
    return F.to_json(F.parse_json(text))


def compact_json(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def concepts_or(found: Column, chapter: Column, least: int = 3, generic: int = 5) -> Column:
    """A chapter's concepts (id, name) if there are ``least`` or more and none has a blank, else ``generic`` made ones."""
    whole = (F.size(found) >= least) & F.forall(found, lambda c: (F.trim(F.coalesce(c["id"], F.lit(""))) != "") & (F.trim(F.coalesce(c["name"], F.lit(""))) != ""))
    made = F.transform(F.sequence(F.lit(1), F.lit(generic)), lambda n: F.struct(F.concat(chapter, F.lit("-c"), n.cast("string")).alias("id"), F.concat(F.lit("Concept "), n.cast("string")).alias("name")))
    return F.when(F.coalesce(whole, F.lit(False)), found).otherwise(made)


def scaled(steps: Column, scale: Column) -> Column:
    """A timeline of (part, delay, duration) at another pace."""
    return F.transform(steps, lambda s: F.struct(s["part"].alias("part"), (s["delay"] * scale).alias("delay"), (s["duration"] * scale).alias("duration")))


def timeline_length(steps: Column) -> Column:
    return F.array_max(F.transform(steps, lambda s: s["delay"] + s["duration"]))


def same_list(a: Column, b: Column) -> Column:
    """Equal lists, order included: null equals null only."""
    return a.eqNullSafe(b)


def headers(subjects: Column, *fields: str) -> Column:
    """A nested list cut down to ``fields`` of each entry."""
    return F.transform(subjects, lambda s: F.struct(*(s[f].alias(f) for f in fields)))


def parsed(text: Column, schema: str) -> Column:
    """JSON as a struct, list or map; no text at all is null. Names are matched as they are written."""
    return F.when(F.trim(text) != "", F.from_json(text, schema))
