"""Schemas of the engine's tables, as DDL."""

FINDING = "ordinal long, type string, location string, line int, severity string, description string, proof string, fix string, taint_trace string, exploit_verified boolean, exploit_proof string, original_severity string, class string, confidence string"
SOURCE_FILE = "path string, content string, type string"
ROUTE = "verb string, uri string, action string, middleware array<string>"
USAGE = "timestamp string, prompt_tokens long, completion_tokens long, total_tokens long, requests long, estimated_cost_usd double, elapsed_seconds double, token_limit long, files_scanned long, files_skipped long, coverage_complete boolean, aborted boolean, path string, score int, provider string, model string"
BASELINE = "fingerprint string, file string, line int, type string, hash string"
GROUND_TRUTH = "line_tolerance int, samples array<struct<file:string,expected:array<struct<type:string,line:int,engine:string,accepted_types:array<string>>>>>"
PRICE = "provider string, model string, input double, output double, context long, tier string, sampling boolean, alias_of string"
HISTORY = "id string, created_at string, scan_duration_ms long, ai_provider string, ai_model string, overall_score int, summary string, vulnerabilities array<struct<type:string,location:string,line:int,severity:string,description:string,proof:string,fix:string,class:string,confidence:string,fingerprint:string>>"
AI_FINDING = "struct<type:string,location:string,line:string,severity:string,description:string,proof:string,fix:string,taint_trace:string>"
AI_RESPONSE = f"struct<vulnerabilities:array<{AI_FINDING}>,overall_score:string,summary:string,ctf_idea:string>"
SAVED_FINDING = "type string, location string, line int, severity string, description string, proof string, fix string, class string, confidence string, fingerprint string"
