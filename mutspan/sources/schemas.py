"""Explicit schemas; readers never infer types from the data."""

MUTANT_INDEX = (
    "row_no long, operator string, line string, method string, class_name string, class_f string, "
    "mutation_statement string, package string, project string, file_path string, original_graph_path string, "
    "mutant_graph_path string, is_killed string, equivalent string"
)

TRAJECTORY = (
    "lineNo long, taskId string, mutantId string, project string, operator string, className string, method string, "
    "line string, outerLoopRound int, runId string, action string, testName string, compileSuccess boolean, "
    "originalPass boolean, killed boolean, mutantExecuted boolean, timedOut boolean, targetStatus string, "
    "repairRounds int, compileCalls int, llmCalls int, promptTokensOrChars long, elapsedMs long, reward double, "
    "failureReason string, exactBucketKey string, coarseBucketKey string, equivalenceSuspicion boolean, "
    "generatedAt string, "
    "state struct<mutantId:string, method:string, line:string, outerLoopRound:int, observablePlanKind:string, "
    "testEntryKind:string, entryInvocationKind:string>, "
    "stateAfter struct<mutantId:string, projectId:string, compiled:boolean, killed:boolean, targetStatus:string, "
    "repairRounds:int, elapsedMillis:long, promptChars:long, evidenceState:struct<className:string, method:string, "
    "operator:string, line:string, outerLoopRound:int>>"
)

# field -> (type, candidate paths); the first usable one counts
TRAJECTORY_PATHS = {
    "line_no": ("long", ["lineNo"]),
    "task_id": ("string", ["taskId"]),
    "mutant_id": ("string", ["mutantId", "stateAfter.mutantId", "state.mutantId"]),
    "project": ("string", ["project", "stateAfter.projectId"]),
    "class_name": ("string", ["className", "stateAfter.evidenceState.className"]),
    "method": ("string", ["method", "state.method", "stateAfter.evidenceState.method"]),
    "operator": ("string", ["operator", "stateAfter.evidenceState.operator"]),
    "line": ("string", ["line", "state.line", "stateAfter.evidenceState.line"]),
    "outer_loop_round": ("int", ["outerLoopRound", "state.outerLoopRound", "stateAfter.evidenceState.outerLoopRound"]),
    "run_id": ("string", ["runId"]),
    "action": ("string", ["action"]),
    "test_name": ("string", ["testName"]),
    "target_status": ("string", ["targetStatus", "stateAfter.targetStatus"]),
    "compile_success": ("boolean", ["compileSuccess", "stateAfter.compiled"]),
    "original_pass": ("boolean", ["originalPass"]),
    "killed": ("boolean", ["killed", "stateAfter.killed"]),
    "timed_out": ("boolean", ["timedOut"]),
    "repair_rounds": ("int", ["repairRounds", "stateAfter.repairRounds"]),
    "compile_calls": ("int", ["compileCalls"]),
    "llm_calls": ("int", ["llmCalls"]),
    "prompt_chars": ("long", ["promptTokensOrChars", "stateAfter.promptChars"]),
    "elapsed_ms": ("long", ["elapsedMs", "stateAfter.elapsedMillis"]),
    "reward": ("double", ["reward"]),
    "failure_reason": ("string", ["failureReason"]),
    "generated_at": ("string", ["generatedAt"]),
}

FEEDBACK = (
    "generatedAt string, taskId string, mutantId string, project string, action string, compiled boolean, "
    "originalPassed boolean, killed boolean, targetStatus string, failureReason string, failureSymptom string, "
    "semanticPlanExhausted boolean, outputJsonPath string, "
    "failureAnalysis struct<symptom:string, failureStage:string, rootCauseType:string, primaryFixTarget:string, "
    "secondaryFixTarget:string, why:string, confidence:double, autoRepairable:boolean, "
    "suspectedMissingImports:array<string>>"
)

GENERATION = (
    "lineNo long, taskId string, compiled string, testSetName string, targetClassName string, methodSignature string, "
    "mutantName string, testJavaFile string, failureReason string, compileMillis long, compileRounds int, "
    "compileCalls int, repairRounds int, llmCalls int, llmMillis long, evidenceMillis long, promptMillis long, "
    "totalMillis long, generatedAt string, reportDir string"
)

SUITE_REPORT = (
    "targetClassName string, className string, target string, methodSignatureFilter string, methodSignature string, "
    "method string, sourceModuleHome string, resultModuleHome string, suiteStatus string, suiteFailureReason string, "
    "sameMethodFallback boolean, suiteMutantScore double, suitePrimaryRuns int, suiteFallbackRuns int, "
    "suiteOriginalSuccessCount int, suiteOriginalFailureCount int, suiteMutantsWithoutMappedTest int, "
    "suiteTimeoutRuns int, suiteTimeoutMutants int, suiteElapsedMillis long, "
    "suiteKilledMutants array<string>, suiteLiveMutants array<string>, suiteMutantResults map<string,string>"
)

TARGET_ENTRY = (
    "rowIndex string, projectName string, targetClassName string, methodSignature string, mutantName string, "
    "testSetName string, javaFile string, classFile string, compiled string, mappingStatus string, "
    "originalPassed string, mutantExecuted string, targetKilled string, targetStatus string, targetFailureReason string"
)

RUN_SUMMARY = "row_no long, exit_code int, duration_ms long, status string, output string, message string"

FAILURE_GROUPS = """groupKey string, className string,
  stats struct<mutantCount:long, javaExistsCount:long, classExistsCount:long, selectedCompileErrorExistsCount:long, graphExistsCount:long, graphMissingCount:long>,
  representative struct<operator:string>, mutants array<struct<rowIndex:long, operator:string>>, omittedMutantCount long"""
