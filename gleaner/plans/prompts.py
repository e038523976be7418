"""What a model is told at each stage, unless the caller's own prompts say otherwise."""

from __future__ import annotations

COMMON = (
    " You get a JSON object with a passage_group, the construction_record of the stages before, and a required_output_schema."
    " Answer with one JSON object that fits the schema, in English, and nothing else."
    " Every quote must be copied letter by letter from a passage of the group and name that passage's source_id and passage_id."
)

PROMPTS = {
    "application": "Invent one question that a reader could answer only by applying what the passages teach to a new case. List every assumption that the question makes." + COMMON,
    "solution": "Answer the question of the record from the passages and its stated assumptions alone, and explain each step." + COMMON,
    "self_check": "Judge the question and its answer severely: does it need application rather than recall, do the passages suffice, are the assumptions spelt out, is the answer right, is all of it English? Name every issue." + COMMON,
    "extraction": "Distil at most three reusable cards from the solution: a concept, its definition, when it applies (trigger), what to do (decision) and what to beware of (pitfall). Ground both texts and each list item of a card, once each, in quotations. Give no card rather than a weak one." + COMMON,
    "card_review": "Judge every card of the extraction once, by its index: is it borne out by the passages, are their conditions kept, is it reusable, is it useful for such questions, does it keep the steps of the solution, is it English? Name missing steps and issues." + COMMON,
    "card_repair": "For each card that the review rejected, and for no other, give a corrected card with its whole grounding, or null if it can't be saved, and the reason." + COMMON,
}
