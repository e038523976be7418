"""A model without a network: answers that follow from the request, for tests and for the end-to-end query."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd

from gleaner.functions.records import CARD_FLAGS, SELF_CHECK_FLAGS


def draw(*parts: object, n: int = 100) -> int:
    """A number below n that depends on nothing but the parts."""
    return int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) % n


def cite(passage: dict, width: int = 40) -> list[dict]:
    return [{"source_id": passage["source_id"], "passage_id": passage["passage_id"], "quote": passage["text"][:width].strip()}]


def grounded(passage: dict, k: int, note: str = "") -> dict:
    text = passage["text"]
    card = {"concept_name": " ".join(text.split()[:3]), "definition": text[:80].strip() + note, "trigger": [f"case {k}"], "decision": ["apply it"], "pitfall": ["not beyond it"] if k % 2 else []}
    places = [("concept_name", None), ("definition", None), *((f, i) for f in ("trigger", "decision", "pitfall") for i in range(len(card[f])))]
    return {"card": card, "grounding": [{"field": f, "item_index": i, "evidence": cite(passage), "support_type": "direct", "rationale": "quoted"} for f, i in places]}


def answer(stage: str, group: dict, record: dict) -> dict:
    """A valid payload of the stage; some groups are refused, some cards rejected, repaired or dropped."""
    gid, passages = group["group_id"], group["passages"]
    proof = cite(passages[0])
    if stage == "application":
        return {"question": "What follows?", "assumptions": [], "evidence": proof}
    if stage == "solution":
        return {"answer": "This.", "explanation": "As quoted.", "evidence": proof}
    if stage == "self_check":
        return {**{f: True for f in SELF_CHECK_FLAGS}, "issues": ["unclear"] if draw(gid, "check") < 10 else [], "evidence": proof}
    if stage == "extraction":
        return {"cards": [grounded(passages[k % len(passages)], k) for k in range(draw(gid, "cards", n=4))]}
    if stage in ("card_review", "repair_review"):
        cards = record["extraction"]["cards"]
        bad = [draw(gid, stage, k) < (30 if stage == "card_review" else 10) for k in range(len(cards))]
        return {"cards": [{"card_index": k, **{f: True for f in CARD_FLAGS}, "source_supported": not b, "missing_steps": [], "issues": ["loose"] if b else [], "evidence": proof} for k, b in enumerate(bad)]}
    rejected = [c["card_index"] for c in record["card_review"]["cards"] if not c["source_supported"]]
    return {"repairs": [{"card_index": k, "replacement": None if draw(gid, "drop", k) < 40 else grounded(passages[0], k, " (repaired)"), "reason": "review"} for k in rejected]}


def scripted_model(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chat completions; on the first attempt some answers are wrapped, cut off or refused, as services do."""
    for batch in batches:
        out = []
        for row in batch.itertuples():
            message = json.loads(json.loads(row.body)["messages"][1]["content"])
            text = json.dumps(answer(row.stage, message["passage_group"], message["construction_record"]), ensure_ascii=False)
            luck = draw(row.group_id, row.stage, row.attempt) if row.attempt == 1 else 99
            finish, status = "stop", 200
            if luck < 4:
                text, finish = text[: len(text) // 2], "length"
            elif luck < 8:
                text = text.replace('"evidence"', '"proof"')
            elif luck < 11:
                status = 503
            elif luck < 20:
                text = "<think>first</think>\n```json\n" + text + "\n```"
            raw = {"model": "scripted", "choices": [{"finish_reason": finish, "message": {"content": text}}], "usage": {"prompt_tokens": len(row.body) // 4, "completion_tokens": len(text) // 4}}
            out.append((row.call_sha256, status, json.dumps(raw, ensure_ascii=False), 0.0))
        yield pd.DataFrame(out, columns=["call_sha256", "status_code", "raw", "latency_s"])
