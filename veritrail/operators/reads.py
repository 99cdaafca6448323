"""Everyday reads: look-ups, listings in order, row checks, and what a user may see of single rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.functions.text import stripped
from veritrail.operators.access import in_scope

#: Bounds of passwords, names, semesters and lines of a page, and the words for states, roles and labels.
PASSWORD, LEAST_NAME, SEMESTERS = (8, 128), 2, (1, 12)
LINE_LENGTH, LINE_CONFIDENCE, LINE_WIDTH, LINE_HEIGHT = 3, 30, 35, 14
STATES, ROLES = ("active", "inactive"), ("student", "teacher", "hod", "admin")
LABELS, NO_LABEL, NO_SUBJECT, NO_ADDRESS = ("Original", "AI-generated", "Mixed"), "Original", "No subjects assigned", "unknown"


def by_id(df: DataFrame, key: str, value) -> DataFrame:
    """The row with an id, or none; the filter reaches the scan."""
    return df.where(F.col(key) == value).limit(1)


def normal_email(email: Column) -> Column:
    return F.lower(F.trim(email))


def by_email(users: DataFrame, column: str, email: str) -> DataFrame:
    """Users with an address, blanks at its ends and case apart."""
    return users.where(normal_email(F.col(column)) == email.strip().lower())


def good_password(password: Column) -> Column:
    low, high = PASSWORD
    return F.coalesce(F.length(password).between(low, high) & password.rlike("[A-Za-z]") & password.rlike(r"\d"), F.lit(False))


def active_subjects(subjects: DataFrame, branch: str | None = None, semester: int | None = None) -> DataFrame:
    """Subjects in use, of one branch or semester where they are given, by code."""
    found = subjects.where("status = 'active'")
    if branch:
        found = found.where(F.col("branch") == branch.strip())
    if semester is not None:
        found = found.where(F.col("semester") == semester)
    return found.orderBy("subject_code")


def newest_first(df: DataFrame, at: str, id: str) -> DataFrame:
    return df.orderBy(F.desc(at), F.desc(id))


def latest_named(df: DataFrame, name: str, part: str, subject: str, id: str) -> DataFrame:
    """The newest row of a subject whose name holds `part`: a top-1 of each partition, then of them."""
    return df.where(F.col(name).contains(part) & (F.col("subject") == subject)).orderBy(F.desc(id)).limit(1)


def readable(text: Column, confidence: Column, width: Column, height: Column) -> Column:
    """Whether a recognised line is long, sure and large enough to learn from."""
    return (F.length(text) >= LINE_LENGTH) & (confidence >= LINE_CONFIDENCE) & (width > LINE_WIDTH) & (height > LINE_HEIGHT)


def teachable(text: Column) -> Column:
    return F.coalesce(F.length(stripped(text)) > 1, F.lit(False))


def subject_rules() -> dict[str, Column]:
    """What holds for a subject's row, by the rule's name."""
    named = lambda c: F.length(F.trim(c)) >= LEAST_NAME
    return {
        "subject_code": named("subject_code"), "subject_name": named("subject_name"), "branch": F.length(F.trim("branch")) > 0,
        "semester": F.col("semester").between(*SEMESTERS), "status": F.lower(F.trim("status")).isin(*STATES),
    }


def user_rules() -> dict[str, Column]:
    """What holds for a user's row."""
    return {"name": F.length(F.trim("name")) >= LEAST_NAME, "role": F.col("role").isin(*ROLES), "password": good_password(F.col("password")), "password_match": F.col("password") == F.col("repeated")}


def violations(df: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """(key, rule) for each rule that a row breaks; a null breaks it. One pass, whatever the number of rules."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules.items())))
    return df.select(key, F.explode(broken).alias("rule"))


def detail_over_summary(summary: DataFrame, detail: DataFrame, key: str) -> DataFrame:
    """Summary rows with their details: of equal names the detail's value, unless there is none."""
    both = [c for c in summary.columns if c in detail.columns and c != key]
    renamed = detail.withColumnsRenamed({c: f"detail_{c}" for c in both})
    joined = summary.join(renamed, key, "left")
    return joined.select(key, *(F.coalesce(f"detail_{c}", c).alias(c) if c in both else c for c in summary.columns if c != key), *(c for c in detail.columns if c not in both and c != key))


def label_of(name: Column) -> Column:
    """A score's label as the report keeps it; what isn't known is original."""
    return F.when(name.isin(*LABELS), name).otherwise(F.lit(NO_LABEL))


def client_address(forwarded: Column, socket: Column) -> Column:
    """The first of the addresses that a proxy names, else the connection's own."""
    first = F.trim(F.element_at(F.split(forwarded, ","), 1))
    return F.when(F.length(forwarded) > 0, first).otherwise(F.coalesce(socket, F.lit(NO_ADDRESS)))


def subject_of_section(mappings: Column, section: Column) -> Column:
    """The first subject that a teacher has in a section."""
    found = F.filter(mappings, lambda m: m["section"] == section)
    return F.when(F.size(found) > 0, F.element_at(found, 1)["subject"]).otherwise(F.lit(NO_SUBJECT))


def has_mapping(mappings: Column, subject: Column, section: Column) -> Column:
    """Whether a subject and section are in the list already, case apart."""
    same = lambda a, b: F.lower(a) == F.lower(b)
    return F.exists(mappings, lambda m: same(m["subject"], subject) & same(m["section"], section))


def sees_user(role: Column, own: Column, wanted: Column) -> Column:
    """Oneself, or anyone for an administrator."""
    return F.coalesce((role == "admin") | (own == wanted), F.lit(False))


def reaches_submission(role: Column, user: Column, action: Column, owner: Column, mappings: Column, section: Column, subject: Column) -> Column:
    """Whether a user may do something with a submission: administrators anything; heads of department all but delete; students with their own; teachers
    all but delete, inside the subjects and sections that they teach. Any other role may do nothing."""
    taught = F.coalesce(in_scope(mappings, F.trim(F.coalesce(section, F.lit(""))), F.trim(F.coalesce(subject, F.lit("")))), F.lit(False))
    allowed = F.when(role == "admin", True).when(role == "student", owner == user).when(role == "hod", action != "delete").when(role == "teacher", (action != "delete") & taught)
    return F.coalesce(allowed, F.lit(False))


def preview(text: Column, length: int) -> Column:
    """The beginning of a long text, marked as cut."""
    return F.when(F.length(text) > length, F.concat(F.left(text, F.lit(length)), F.lit("..."))).otherwise(text)


def row_quality(df: DataFrame, text: str, cleaned: Callable[[Column], Column], tagged: Callable[[Column], Column]) -> DataFrame:
    """One row: texts that are missing, that hold markup, and that cleaning changes."""
    t = F.col(text)
    return df.agg(F.count("*").alias("rows"), F.count_if(t.isNull()).alias("missing"), F.count_if(tagged(t)).alias("tagged"), F.count_if(cleaned(t) != stripped(t)).alias("changed"))


def page_confidence(lines: DataFrame, page: str, confidence: str) -> DataFrame:
    """Each page's mean confidence to one digit, from whole hundredths."""
    hundredths = F.sum(F.round(F.col(confidence) * 100).cast("long"))
    n = F.count(confidence)
    return lines.groupBy(page).agg(F.count("*").alias("lines"), (F.call_function("div", hundredths * 2 + n * 10, F.nullif(n * 20, F.lit(0))) / 10.0).alias("confidence"))
