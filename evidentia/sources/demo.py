"""A small made-up replay corpus: a fully proven pump, one proven by two pages, a silent one, and a contradicted one."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

REQUIREMENTS = {
    "product": "Three stage pump",
    "origin_brand": "",
    "criteria": [
        {"id": "supply", "label": "Supply voltage", "requested_value": "12 V DC"},
        {"id": "load", "label": "Rated current", "requested_value": "5 A"},
        {"id": "stages", "label": "Number of stages", "requested_value": "3 stages"},
    ],
}
AMARO, BELIX, RESELLER, CORUN, DAVEL = "https://amaro.example/items/am-310", "https://belix.example/catalogue/bx-310", "https://parts-store.example/belix/bx-310", "https://corun.example/items/cr-310", "https://davel.example/en/dv-310"
PAGES = {
    AMARO: "Amaro AM-310 three stage pump.\nSupply voltage 12 V DC. Rated current 5 A. 3 stages.\nFoot mounted.",
    BELIX: "Belix BX-310 three stage pump.\nSupply voltage 12 V DC. Rated current 5 A.\nAsk for the full datasheet.",
    RESELLER: "BX-310 by Belix, industrial pump.\n3 stages, flange or foot.\nShips in two days.",
    CORUN: "Corun CR-310 three stage pump.\nAsk your dealer for details.\nSold in single boxes.",
    DAVEL: "Davel DV-310 three stage pump.\nSupply voltage 36 V DC. Rated current 5 A. 3 stages.\nFor 36 V systems.",
}
BRANDS = {"domaines_officiels": {"amaro": ["amaro.example"], "belix": ["belix.example"], "corun": ["corun.example"], "davel": ["davel.example"]}, "alias_canoniques": {}}


def criterion(at: int, observed: str, status: str, *proofs: tuple[str, str]) -> dict:
    c = REQUIREMENTS["criteria"][at]
    kind = lambda url: "web_secondaire" if url == RESELLER else "web_officiel"
    return {"requirement_id": c["id"], "requested_value": c["requested_value"], "observed_value": observed, "status": status, "proofs": [{"url": u, "excerpt": e, "type": kind(u)} for u, e in proofs]}


def audit(url: str, brand: str, reference: str, *criteria: dict, deviations: tuple[str, ...] = (), limitations: tuple[str, ...] = ()) -> dict:
    return {"page_url": url, "candidates": [{"brand": brand, "reference": reference, "criteria": list(criteria), "deviations": list(deviations), "limitations": list(limitations)}]}


AUDITS = [
    audit(AMARO, "Amaro", "AM-310", criterion(0, "12 V DC", "proven", (AMARO, "Supply voltage 12 V DC")), criterion(1, "5 A", "proven", (AMARO, "Rated current 5 A")), criterion(2, "3 stages", "proven", (AMARO, "3 stages"))),
    audit(DAVEL, "Davel", "DV-310", criterion(0, "36 V DC", "incompatible", (DAVEL, "Supply voltage 36 V DC")), criterion(1, "5 A", "proven", (DAVEL, "Rated current 5 A")), criterion(2, "3 stages", "proven", (DAVEL, "3 stages")), deviations=("36 V DC instead of 12 V.",)),
    audit(BELIX, "Belix", "BX-310", criterion(0, "12 V DC", "proven", (BELIX, "Supply voltage 12 V DC")), criterion(1, "5 A", "proven", (BELIX, "Rated current 5 A")), criterion(2, "", "not_proven")),
    audit(RESELLER, "Belix", "BX-310", criterion(0, "", "not_proven"), criterion(1, "", "not_proven"), criterion(2, "3 stages", "proven", (RESELLER, "3 stages")), limitations=("Stages only by a reseller.",)),
    audit(CORUN, "Corun", "CR-310", criterion(0, "", "not_proven"), criterion(1, "", "not_proven"), criterion(2, "", "not_proven"), limitations=("No values on the page.",)),
]


def manifest() -> dict:
    seen = ["pump|supply|12 v dc"]
    wave = lambda n, a, b, s: {"wave": n, "logical_queries_at_entry": a, "logical_queries_before_near_miss": b, "seen_signatures_at_entry": s, "seen_signatures_before_near_miss": s}
    digest = hashlib.sha256(b"demo").hexdigest()
    return {"schema_version": 1, "generated_at": "2026-01-01T00:00:00Z", "target_brand": "", "threshold": 75, "strict_evidence": True, "B2_MODEL": "demo", "code": {"git_commit": "unavailable", "sha256": digest}, "fiche": {"path": "", "sha256": digest, "hash_scope": "extracted_text"}, "audit_waves": [1, 1, 2, 2, 2], "page_waves": {AMARO: 1, DAVEL: 1, BELIX: 2, RESELLER: 2, CORUN: 2}, "waves": [wave(1, 0, 3, []), wave(2, 3, 6, seen)]}


def write(folder: str | Path) -> str:
    """Writes the corpus; its bytes are the same each time."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    for name, value in (("requirements", REQUIREMENTS), ("audits", AUDITS), ("pages", PAGES), ("manifest", manifest())):
        (folder / f"{name}.json").write_text(json.dumps(value, ensure_ascii=False, indent=2), encoding="utf-8")
    return str(folder)


def tables() -> dict[str, str]:
    """The four files' contents by name."""
    return {name: json.dumps(value, ensure_ascii=False) for name, value in (("requirements", REQUIREMENTS), ("audits", AUDITS), ("pages", PAGES), ("manifest", manifest()))}


def brands():
    from evidentia.operators.identity import Brands

    return Brands({frozenset([b]): frozenset(d) for b, d in BRANDS["domaines_officiels"].items()})
