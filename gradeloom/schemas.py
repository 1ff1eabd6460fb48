"""Explicit schemas; nothing is inferred."""

from pyspark.sql import types as T

S, D, L, I, B = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.BooleanType()


def struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


TASK = struct(
    task_id=S, language=S, goal=S, buggy=S, reference_fix=S, file_name=S, project=S, category=S,
    category_confidence=D, category_reason=S, classifier=S, oracle=struct(kind=S), derived_from=S,
    source_session=S, source_title=S, is_test_file=B, goal_had_alternatives=B, goal_relevance=D,
    goal_source=S, original_goal=S)

DIAGNOSE = struct(total=D, location_match=D, judge_agreement=D, category_match=D,
                  expected_category=S, error=S, latency_ms=L, raw=S)
REPAIR = struct(total=D, rank_score=D, patch_reproduction=D, judge_agreement=D, oracle_score=D,
                oracle=S, candidate=S, raw=S, error=S, latency_ms=L)
RESULT = struct(
    model=S, task_id=S, language=S, category=S, project=S, file_name=S, ts=L, diagnose=DIAGNOSE,
    repair=REPAIR, repair_given=REPAIR, combined=D, diagnosis_uplift=D, diagnose_error=S,
    repair_error=S, repair_given_error=S, tainted=S, taint_reason=S, empty_reply=B, manifest_hash=S)

ATTEMPT = struct(
    model=S, task_id=S, outcome=S, ok=B, latency_s=D, patch_chars=L, error=S, manifest_hash=S,
    per_bug_score=D, bugs_fixed=L, bugs_total=L, file_clear=B, codebase=S, language=S, order_index=L)

PANEL_TASK = struct(
    task_id=S, codebase=S, module=S, bug_id=S, symbol=S, operator=S, line=L, test_node=S,
    n_failing=L, depth=S, difficulty=S, green_tests=T.ArrayType(S))
PANEL_SHARD = struct(tasks=T.ArrayType(PANEL_TASK), **{f.name: f.dataType for f in PANEL_TASK})

TOOL_PART = struct(
    type=S, tool=S, text=S,
    state=struct(status=S, output=S, input=struct(
        filePath=S, path=S, content=S, oldString=S, newString=S, oldText=S, newText=S, command=S)))

FRAME_MESSAGE = struct(author=S, contentType=S, messageType=S, text=S, hiddenText=S, requestId=S)
FRAME = struct(
    type=I, target=S, error=S, requestId=S,
    arguments=T.ArrayType(struct(writeAtCursor=S, isLastUpdate=B, requestId=S,
                                 messages=T.ArrayType(FRAME_MESSAGE))),
    item=struct(requestId=S, result=struct(value=S, message=S), messages=T.ArrayType(FRAME_MESSAGE)))
