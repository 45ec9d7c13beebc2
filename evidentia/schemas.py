"""Explicit schemas of the tables that the engine works on. Nothing is inferred."""

from __future__ import annotations

PROOF = "struct<url:string,excerpt:string,type:string>"
CRITERION = f"struct<requirement_id:string,requested_value:string,observed_value:string,status:string,proofs:array<{PROOF}>>"
CANDIDATE = f"struct<brand:string,reference:string,criteria:array<{CRITERION}>,deviations:array<string>,limitations:array<string>>"
REQUIREMENTS_JSON = "product string, origin_brand string, criteria array<struct<id:string,label:string,requested_value:string,critical:boolean>>"
AUDITS_JSON = f"page_url string, candidates array<{CANDIDATE}>"
WAVE = "struct<wave:int,logical_queries_at_entry:int,logical_queries_before_near_miss:int,seen_signatures_at_entry:array<string>,seen_signatures_before_near_miss:array<string>>"
MANIFEST_JSON = f"schema_version int, generated_at string, target_brand string, threshold int, strict_evidence boolean, B2_MODEL string, code struct<git_commit:string,sha256:string>, fiche struct<path:string,sha256:string,hash_scope:string>, audit_waves array<int>, page_waves map<string,int>, waves array<{WAVE}>"
MISSIONS = "mission_id string, product string, origin_brand string, target_brand string, threshold int, strict boolean"
REQUIREMENTS = "mission_id string, ord int, requirement_id string, label string, requested_value string, critical boolean"
CRITERIA = f"mission_id string, candidate_id string, brand string, reference string, page_url string, audit_ord int, ord int, requirement_id string, requested_value string, observed_value string, status string, proofs array<{PROOF}>"
PAGES = "mission_id string, url string, title string, content string"
