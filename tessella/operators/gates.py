"""Structural gates of generated pairs: ordered rules with the first failure as reason.

A gate is data, a list of (failure, column that is true when it fails), and is
compiled to one CASE expression.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The vocabularies of the gates. A blank stands for any white space.
MATH_OPERATORS = "[=+*/^×÷]"
MATH_MINUS = r"(?U)(?<!\w)-(?!\w)|(?<=\d)-|-(?=\d)"
UNICODE_MATH = "[⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾₀₁₂₃₄₅₆₇₈₉]"
LOCATIVES = (
    r"is (?:now )?(?:in|at|on|inside|located)", r"are (?:now )?(?:in|at|on|inside|located)", r"remains? (?:at|in|on)", r"currently (?:in|at|on)",
    r"now (?:in|at|on|sits?)", r"located (?:in|at|on)", "moved to", "transferred to", r"placed (?:in|at|on)", r"stored (?:in|at|on)",
    r"sitting (?:in|at|on)", r"resting (?:in|at|on)", r"ended up (?:in|at)", r"wound up (?:in|at)", r"brought .{0,30} to", r"carried .{0,30} to", r"delivered .{0,30} to",
)
CAUSAL_FORBIDDEN = (
    r"if \w+ had", "would have", "could have", "might have", "should have", "were it not", r"had \w+ not", r"without \w+.{0,20}\bthen",
    "because", "therefore", "consequently", "as a result", "caused", "prevented", "led to", "resulted in", "due to", "owing to", "in order to", "so that", "thus", "hence",
)
COUNTERFACTUALS = (r"if \w+ had", "would have", "could have", "were it not", r"had \w+ not", "would not have", "wouldn't have")
CAUSAL_MARKERS = ("because", "therefore", "caused", "prevented", "led to", "resulted in", "as a result", "consequently", "sufficient", "necessary")
LOGIC_MARKERS = ("therefore", "hence", "thus", "QED", "it follows", "by definition", "by assumption", "by hypothesis", "we have", "we get", "we obtain", "implies that", "if and only if", "proof")
STEP = r"\bstep\s+\d"
EQUATION, FORBIDDEN_EQUATION = "[=≥≤><≠∈∀∃]", "[=≥≤≠∈∀∃]"
STEP_NUMBER = r"(?iU)step\s*\d"
CONTRACTIONS = r"(?iuU)\b\w+n't\b|\b\w+'re\b|\b(?:it|he|she|that|there|here|what|who|where|how|when|why)'s\b|\b\w+'ve\b|\b\w+'ll\b|\b\w+'d\b|\bI'm\b|\blet's\b"
PERSONS = r"(?U)\b(?:I|me|my|mine|myself|you|your|yours|yourself|we|us|our|ours|ourselves)\b"
MENTAL = "(?:known|believed|thought|realized|understood|been)"
COGNITIVE = ("therefore", rf"if \w+ had {MENTAL}", f"would have {MENTAL}", "believed that", "intended to", "knew that", "unaware", "equation", "theorem", "proof", "implies that")
ENTITY_STOP_WORDS = ("the", "a", "an", "in", "on", "at", "to", "of", "for", "and", "or", "with")
CONCEPT_STOP_WORDS = ("the", "for", "and", "with", "from", "over", "that", "this", "into", "onto", "about", "using")
SHORTEST = 100
LONGEST = {"spl_cc": 2000, "tom_cc": 2000, "mor_cc": 2000, "str_cc": 2000, "stp_cc": 2000, "ctr_cc": 2500, "null_cc": 2500, "core_math": 2500, "coin": 2500}


def phrases(terms: Sequence[str], end: str = r"\b") -> str:
    """Any of the terms as whole words, whatever their case and the white space between."""
    return r"(?iuU)\b(?:" + "|".join(t.replace(" ", r"\s+") + end for t in terms) + ")"


LOGIC = phrases(LOGIC_MARKERS) + "|" + STEP


@dataclass(frozen=True)
class Rule:
    """Fails where ``fails`` holds. ``pattern`` and ``text`` add the match, its place and its surroundings to the reason."""

    reason: str
    fails: Column
    pattern: str | None = None
    text: Column | None = None
    around: int = 30

    def message(self) -> Column:
        if self.pattern is None:
            return F.lit(self.reason)
        at = F.regexp_instr(self.text, F.lit(self.pattern))
        found = F.regexp_substr(self.text, F.lit(self.pattern))
        start = F.greatest(at - self.around, F.lit(1))
        near = F.substr(self.text, start, at - start + self.around)
        return F.concat(F.lit(f"{self.reason} '"), found, F.lit("' at pos "), (at - 1).cast("string"), F.lit(": '..."), near, F.lit("...'"))


@dataclass(frozen=True)
class Gate:
    rules: list[Rule] = field(default_factory=list)

    def reason(self) -> Column:
        """The first failure, null where the row passes."""
        found = F.lit(None).cast("string")
        for rule in reversed(self.rules):
            found = F.when(F.coalesce(rule.fails, F.lit(True)), rule.message()).otherwise(found)
        return found


def length_rules(side: str, text: Column, longest: int) -> list[Rule]:
    n = F.length(F.coalesce(text, F.lit("")))
    return [Rule(f"{side} too short", n < SHORTEST), Rule(f"{side} too long", n > longest)]


def forbids(side: str, what: str, text: Column, pattern: str, around: int = 30) -> Rule:
    return Rule(f"{side} contains {what}", text.rlike(pattern), pattern, text, around)


def needs(side: str, what: str, text: Column, pattern: str) -> Rule:
    return Rule(f"{side} missing {what}", ~text.rlike(pattern))


def gate(corpus: str, target: Column, retain: Column) -> Gate:
    """The gate of a corpus; those that only a judge sees have the length window alone."""
    longest = LONGEST.get(corpus, LONGEST["coin"])
    sizes = {"target": length_rules("target", target, longest), "retain": length_rules("retain", retain, longest)}
    own: dict[str, dict[str, list[Rule]]] = {
        "spl_cc": {
            "target": [needs("target", "equals sign", target, "="), needs("target", "digits", target, r"(?U)\d")],
            "retain": [
                forbids("retain", "digit", retain, r"(?U)\d", 20), forbids("retain", "math operator", retain, MATH_OPERATORS, 20),
                forbids("retain", "math minus", retain, MATH_MINUS, 20), forbids("retain", "unicode math char", retain, UNICODE_MATH, 20),
            ],
        },
        "stp_cc": {"target": [needs("target", "locative", target, phrases(LOCATIVES))], "retain": [forbids("retain", "locative", retain, phrases(LOCATIVES))]},
        "ctr_cc": {
            "target": [needs("target", "counterfactual marker", target, phrases(COUNTERFACTUALS)), needs("target", "causal marker", target, phrases(CAUSAL_MARKERS))],
            "retain": [forbids("retain", "causal marker", retain, phrases(CAUSAL_FORBIDDEN))],
        },
        "core_math": {
            "target": [needs("target", "formal logic marker", target, LOGIC), needs("target", "equation symbol", target, EQUATION)],
            "retain": [forbids("retain", "formal logic marker", retain, LOGIC), forbids("retain", "equation symbol", retain, FORBIDDEN_EQUATION), forbids("retain", "step numbering", retain, STEP_NUMBER)],
        },
        "null_cc": {
            "target": [forbids("target", "contraction", target, CONTRACTIONS), forbids("target", "person", target, PERSONS), forbids("target", "cognitive marker", target, phrases(COGNITIVE))],
            "retain": [Rule("retain has no informal marker", ~(retain.rlike(CONTRACTIONS) | retain.rlike(PERSONS))), forbids("retain", "cognitive marker", retain, phrases(COGNITIVE))],
        },
    }
    rules = own.get(corpus, {})
    return Gate([r for side in ("target", "retain") for r in [*sizes[side], *rules.get(side, [])]])


def entities_kept(target: Column, retain: Column, entities: Column) -> Column:
    """Every entity that the target names stands in the retain text."""
    t, r = F.lower(target), F.lower(retain)
    return F.forall(entities, lambda e: ~F.contains(t, F.lower(e)) | F.contains(r, F.lower(e)))


def entities_mostly_kept(target: Column, retain: Column, entities: Column) -> Column:
    """Of three or more entities that the target names at least 0.34 are in the retain text, whole or by half of their content words."""
    t, r = F.lower(target), F.lower(retain)
    named = F.filter(F.transform(entities, F.lower), lambda e: F.contains(t, e))
    stop = F.array(*[F.lit(w) for w in ENTITY_STOP_WORDS])
    content = lambda e: F.filter(F.split(e, r"(?U)\s+"), lambda w: (w != "") & ~F.array_contains(stop, w))

    def found(e: Column) -> Column:
        own = content(e)
        return F.contains(r, e) | (F.size(own) == 0) | (F.size(F.filter(own, lambda w: F.contains(r, w))) >= 0.5 * F.size(own))

    return (F.size(named) < 3) | (F.size(F.filter(named, found)) >= 0.34 * F.size(named))


def concept_kept(target: Column, retain: Column, concept: Column) -> Column:
    """Some term of the concept that the target uses is in the retain text; true where the target uses none."""
    stop = F.array(*[F.lit(w) for w in CONCEPT_STOP_WORDS])
    terms = F.filter(F.split(F.lower(concept), r"(?U)[\s,/\-]+"), lambda w: (F.length(w) > 3) & ~F.array_contains(stop, w))
    used = F.filter(terms, lambda w: F.contains(F.lower(target), w))
    return (F.size(used) == 0) | F.exists(used, lambda w: F.contains(F.lower(retain), w))


def validate(pairs: DataFrame, corpus: str, target: str = "target", retain: str = "retain") -> DataFrame:
    """Adds ``reason``, null for rows that pass."""
    return pairs.withColumn("reason", gate(corpus, F.col(target), F.col(retain)).reason())
