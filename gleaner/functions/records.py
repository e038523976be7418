"""The records of the data model: strict specs for their JSON, and Spark types."""

from __future__ import annotations

from gleaner.functions.strict import Choice, Flag, Index, Items, Record, Text

# Limits of the data model.
MAX_PASSAGE, MAX_GROUP, MAX_PASSAGES = 12_000, 30_000, 5
MAX_CARDS = 3
SELF_CHECK_FLAGS = ("requires_application", "source_sufficient", "assumptions_explicit", "answer_correct", "english_only")
CARD_FLAGS = ("source_supported", "conditions_preserved", "reusable", "useful_application", "solution_steps_preserved", "english_only")
STAGES = ("application", "solution", "self_check", "extraction", "card_review", "card_repair", "repair_review")


def group_spec(corpora: tuple[str, ...], languages: tuple[str, ...] = ("en",)) -> Record:
    passage = Record({"source_id": Text(), "passage_id": Text(), "title": Text(blank=True, required=False), "text": Text(most=MAX_PASSAGE)})
    return Record({"group_id": Text(), "subject": Text(), "corpus": Choice(corpora), "language": Choice(languages), "passages": Items(passage, 1, MAX_PASSAGES)})


_citation = Record({"source_id": Text(), "passage_id": Text(), "quote": Text()})
_evidence = Items(_citation, 1)
_texts = Items(Text())
_some = Items(Text(), 1)
_card = Record({"concept_name": Text(), "definition": Text(), "trigger": _some, "decision": _some, "pitfall": _texts})
_grounding = Record({"field": Choice(("concept_name", "definition", "trigger", "decision", "pitfall")), "item_index": Index(null=True), "evidence": _evidence, "support_type": Choice(("direct", "derived")), "rationale": Text()})
_grounded = {"card": _card, "grounding": Items(_grounding)}
_review = Record({"cards": Items(Record({"card_index": Index(), **{f: Flag() for f in CARD_FLAGS}, "missing_steps": _texts, "issues": _texts, "evidence": _evidence}), 0, MAX_CARDS)})
_repair = Record({"repairs": Items(Record({"card_index": Index(), "replacement": Record(_grounded, null=True), "reason": Text()}), 1, MAX_CARDS)})

STAGE_SPECS = {
    "application": Record({"question": Text(), "assumptions": _texts, "evidence": _evidence}),
    "solution": Record({"answer": Text(), "explanation": Text(), "evidence": _evidence}),
    "self_check": Record({**{f: Flag() for f in SELF_CHECK_FLAGS}, "issues": _texts, "evidence": _evidence}),
    "extraction": Record({"cards": Items(Record(_grounded), 0, MAX_CARDS)}),
    "card_review": _review,
    "card_repair": _repair,
    "repair_review": _review,
}

CITATION = "struct<source_id:string,passage_id:string,quote:string>"
CARD = "struct<concept_name:string,definition:string,trigger:array<string>,decision:array<string>,pitfall:array<string>>"
GROUNDING = f"struct<field:string,item_index:int,evidence:array<{CITATION}>,support_type:string,rationale:string>"
GROUNDED = f"struct<card:{CARD},grounding:array<{GROUNDING}>>"
JUDGMENT = f"struct<card_index:int,{','.join(f'{f}:boolean' for f in CARD_FLAGS)},missing_steps:array<string>,issues:array<string>,evidence:array<{CITATION}>>"
PASSAGE = "struct<source_id:string,passage_id:string,title:string,text:string>"

STAGE_TYPES = {
    "application": f"struct<question:string,assumptions:array<string>,evidence:array<{CITATION}>>",
    "solution": f"struct<answer:string,explanation:string,evidence:array<{CITATION}>>",
    "self_check": f"struct<{','.join(f'{f}:boolean' for f in SELF_CHECK_FLAGS)},issues:array<string>,evidence:array<{CITATION}>>",
    "extraction": f"struct<cards:array<{GROUNDED}>>",
    "card_review": f"struct<cards:array<{JUDGMENT}>>",
    "card_repair": f"struct<repairs:array<struct<card_index:int,replacement:{GROUNDED},reason:string>>>",
    "repair_review": f"struct<cards:array<{JUDGMENT}>>",
}
