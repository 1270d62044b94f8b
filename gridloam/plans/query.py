"""Questions as plans: what to compute, where and when."""

from __future__ import annotations

import difflib
import functools
import json
import re
from dataclasses import dataclass, field, replace

from gridloam.plans import dates
from gridloam.plans import vocabulary as V


class UnknownRegion(ValueError):
    """Names some of the regions there are."""

    def __init__(self, name: str, known: list[str]):
        super().__init__(f"no region {name!r}; there are {', '.join(sorted(known)[:8])} and others")


@dataclass(frozen=True)
class Plan:
    """A typed question. `problem` says what is missing: a region, a date, or enough text."""

    operation: str
    regions: tuple[str, ...] = ()
    spans: tuple[dates.Span, ...] = ()
    metric: str = "mean"
    compare_by: str | None = None
    output: str = "both"
    problem: str | None = None
    warnings: tuple[str, ...] = field(default=())

    def explain(self) -> str:
        where = ", ".join(self.regions) or "no region"
        when = "; ".join(f"{a}..{b}" for a, b in self.spans) or "all days"
        by = f" by {self.compare_by} on {self.metric}" if self.operation == "comparison" else ""
        return f"{self.operation}{by} of {where} over {when} as {self.output}" + (f" ({self.problem})" if self.problem else "")

    def patch(self, reply: str) -> Plan:
        """The plan with the region or dates that a follow-up gives."""
        text = normalised(reply)
        regions, spans = find_regions(text) or self.regions, tuple(dates.spans(text)) or self.spans
        return checked(replace(self, regions=tuple(regions), spans=tuple(spans), problem=None))

    def bind(self, first: str, last: str, whole_if_outside: bool = False) -> Plan:
        """Spans put in order and brought into the days there are; those wholly outside go, with a warning.

        If none is left, `whole_if_outside` takes all days instead.
        """
        out, said = [], list(self.warnings)
        for a, b in self.spans or ((first, last),):
            a, b = min(a, b), max(a, b)
            if b < first or a > last:
                said.append(f"{a}..{b} has no data; there is {first}..{last}")
                continue
            if a < first or b > last:
                said.append(f"{a}..{b} was cut to {max(a, first)}..{min(b, last)}")
            out.append((max(a, first), min(b, last)))
        if not out and whole_if_outside:
            said.append(f"all days, {first}..{last}, stand in")
            out = [(first, last)]
        return replace(self, spans=tuple(out), warnings=tuple(said))


def month_bounds(text: str, first: bool, compat_28: bool = False) -> str:
    """A day of `YYYY-MM`: the first, or the last (or the 28th, as older plans had it); days stay as they are."""
    if not re.fullmatch(r"\d{4}-\d{2}", text):
        return text
    y, m = map(int, text.split("-"))
    return f"{text}-01" if first else f"{text}-28" if compat_28 else dates.day(y, m, 31).isoformat()


_KNOWN = {w for r in V.REGIONS for w in r.split() if len(w) > 4}


@functools.lru_cache(maxsize=50_000)
def _put_right(word: str) -> str:
    """The region's word that a word is a misspelling of, or the word itself."""
    if len(word) < 6 or word in _KNOWN or word in V.SEASONS or word in V.MONTHS:
        return word
    return (difflib.get_close_matches(word, _KNOWN, 1, 0.85) or [word])[0]


def normalised(question: str) -> str:
    """Lower-cased, quotes gone, short names and misspelt region words put right."""
    q = re.sub(r"[\"'`]", "", question.lower()).strip()
    for short, name in V.ALIASES.items():
        q = re.sub(rf"\b{re.escape(short)}\b", name, q)
    return re.sub(r"[a-z]+", lambda m: _put_right(m[0]), q)


def find_regions(q: str) -> list[str]:
    """Regions in the order in which they are named; the nation only if no other is."""
    found, rest = [], q
    for r in sorted(V.REGIONS, key=len, reverse=True):
        if r in rest:
            found.append(r)
            rest = rest.replace(r, " ")
    found.sort(key=q.find)
    return found or ([V.NATIONAL] if any(w in q for w in ("india", "national", "country")) else [])


def resolve_region(name: str, known: list[str], cutoff: float = 0.6) -> str:
    """The known region that a name means, by alias or likeness."""
    n = V.ALIASES.get(name.lower().strip(), name.lower().strip())
    if n == V.NATIONAL or n in known:
        return n
    near = difflib.get_close_matches(n, known, 1, cutoff)
    if not near:
        raise UnknownRegion(name, known)
    return near[0]


def operation_of(q: str) -> str:
    """comparison, a ranking, maximum, minimum, mean or slope; the first that the words ask for."""
    has = lambda words: any(w in q for w in words)
    years, regions = re.findall(r"\b\d{4}\b", q), find_regions(q)
    if has(V.COMPARING) and (len(years) > 1 or len(regions) > 1 or has((" vs ", " vs.", "versus"))):
        return "comparison"
    place = r"\s+(state|region|part)\b"
    if re.search(r"\b(driest|least moisture)" + place, q):
        return "driest_region"
    if re.search(r"\b(wettest|most moisture|highest|maximum)" + place, q):
        return "wettest_region"
    if re.search(r"\b(maximum|max|highest|wettest|most moisture|peak)\b", q):
        return "maximum"
    if re.search(r"\b(minimum|min|lowest|driest|least moisture)\b", q):
        return "minimum"
    if has(V.MEAN):
        return "mean"
    if has(V.SLOPE) or not has(V.PAPER) and has(V.SLOPE_UNLESS_PAPER) or re.search(r"\bplot\b", q):
        return "slope"
    return "comparison" if has(V.COMPARING) else "mean"


def metric_of(q: str) -> str:
    for name, words in (("min", "min|minimum|driest|lowest"), ("max", "max|maximum|wettest|highest|peak"), ("slope", "slope|trend|rate")):
        if re.search(rf"\b({words})\b", q):
            return name
    return "mean"


def output_of(q: str, operation: str) -> str:
    """scalar, map or both."""
    has = lambda words: any(w in q for w in words)
    if has(V.SCALAR_ONLY):
        return "scalar"
    if has(V.BOTH):
        return "both"
    if re.search(r"\b(only|just)\s+(the\s+)?(spatial\s+)?map\b|\bmap only\b|\bno\s+(numbers?|values?|stats?|statistics?)\b", q):
        return "map"
    if has(V.MAP_WORDS):
        return "both"
    return "scalar" if has(V.SCALAR_WORDS) and operation != "comparison" else "both"


def checked(plan: Plan) -> Plan:
    """Says what a plan lacks."""
    if plan.operation in ("coverage", "best_year", "driest_region", "wettest_region"):
        return plan
    if not plan.regions:
        return replace(plan, problem="which region?")
    if plan.operation == "comparison" and plan.compare_by == "time" and len(plan.spans) < 2:
        return replace(plan, problem="which periods?")
    if not plan.spans and plan.operation != "comparison":
        return replace(plan, problem="which dates?")
    return plan


OPERATIONS = ("mean", "minimum", "maximum", "slope", "comparison", "coverage", "best_year", "driest_region", "wettest_region")


def valid_operation(name: str) -> bool:
    return name in OPERATIONS


def follow_up(plan: Plan) -> str | None:
    """What to ask back for a plan that lacks something."""
    if plan.problem is None:
        return None
    if plan.problem == "which region?":
        when = f" for {plan.spans[0][0]}" if plan.spans else ""
        return f"Which region should I look at{when}? Say India, Rajasthan or Punjab, for example."
    if plan.problem == "which dates?":
        where = f" for {plan.regions[0].title()}" if plan.regions else ""
        return f"Which date or period should I use{where}? Say June 2020, 01-06-2020 or monsoon 2021, for example."
    if plan.problem == "which periods?":
        return "A comparison needs two things. Name several periods, or two regions."
    return "Could you say that again, with a region and a date?"


def embedded_json(text: str) -> dict | None:
    """The first JSON object in a text that may hold more, or None."""
    for m in re.finditer(r"\{", text):
        try:
            got, _ = json.JSONDecoder().raw_decode(text, m.start())
        except ValueError:
            continue
        if isinstance(got, dict):
            return got
    return None


def refined(plan: Plan, reply: str) -> Plan:
    """A plan with what a language model's reply (JSON with `confident` true) says of its operation, region and dates."""
    said = embedded_json(reply) or {}
    if said.get("confident") is not True:
        return plan
    change: dict = {}
    if valid_operation(str(said.get("operation"))):
        change["operation"] = said["operation"]
    if isinstance(said.get("region"), str) and said["region"].strip():
        change["regions"] = (said["region"].strip().lower(),)
    a, b = said.get("start_date"), said.get("end_date")
    if all(isinstance(x, str) and re.fullmatch(r"\d{4}-\d{2}(-\d{2})?", x) for x in (a, b)):
        change["spans"] = (tuple(sorted((month_bounds(a, True), month_bounds(b, False)))),)
    return checked(replace(plan, problem=None, **change))


def parse(question: str, evaluation: bool = False) -> Plan:
    """The plan of a question about the grid."""
    q = normalised(question)
    if len(q) < 5:
        return Plan("mean", problem="too short")
    has_year = re.search(r"\b20\d{2}\b", q) is not None
    if any(w in q for w in V.COVERAGE) and not has_year:
        return Plan("coverage", (V.NATIONAL,))
    if any(w in q for w in V.BEST_YEAR) and not has_year:
        return Plan("best_year", (V.NATIONAL,), metric="min" if re.search(r"lowest|driest|worst|least", q) else "max")
    operation, regions = operation_of(q), find_regions(q)
    metric, by, when = "mean", None, dates.spans(q, evaluation)
    if operation == "comparison":
        by, metric = ("region" if len(regions) > 1 else "time"), metric_of(q)
        if by == "time":
            when = dates.compared(q, evaluation)
    elif operation in V.AS_METRIC and len(when) > 1 and len(regions) == 1 and all(a.endswith("-01-01") and b.endswith("-12-31") for a, b in when):
        operation, by, metric = "comparison", "time", V.AS_METRIC[operation]  # years that are listed are compared
    return checked(Plan(operation, tuple(regions), tuple(when), metric, by, output_of(q, operation)))
