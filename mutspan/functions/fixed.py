"""Labels, word lists, weights and limits that results depend on."""

# --- fixed values: statuses ------------------------------------------------
KILLED = "KILLED"
SURVIVED = "SURVIVED"
EQUIVALENT_SUSPECTED = "EQUIVALENT_SUSPECTED"
ORIGINAL_FAILED = "ORIGINAL_FAILED"
TIMEOUT = "TIMEOUT"
SKIPPED_BY_EVIDENCE = "SKIPPED_BY_EVIDENCE"
LLM_OUTPUT_INVALID = "LLM_OUTPUT_INVALID"
LLM_NO_VISIBLE_CODE = "LLM_NO_VISIBLE_CODE"
COMPILE_FAILED_AFTER_GENERATION = "COMPILE_FAILED_AFTER_GENERATION"
COMPILE_FAILED_AFTER_REPAIR = "COMPILE_FAILED_AFTER_REPAIR"
API_FAILED = "API_FAILED"
GENERATION_FAILED = "GENERATION_FAILED"
TASK_CRASHED = "TASK_CRASHED"
NOT_EXECUTED = "NOT_EXECUTED"

EXECUTED_STATUSES = [KILLED, SURVIVED, EQUIVALENT_SUSPECTED, ORIGINAL_FAILED, TIMEOUT]
NON_EXECUTED_STATUSES = [
    "SKIP_NOT_COMPILED",
    "SKIPPED_BY_EVIDENCE",
    "LLM_OUTPUT_INVALID",
    "LLM_NO_VISIBLE_CODE",
    "COMPILE_FAILED_AFTER_GENERATION",
    "COMPILE_FAILED_AFTER_REPAIR",
    "API_FAILED",
    "GENERATION_FAILED",
    "TASK_CRASHED",
    "NOT_EXECUTED",
]
COMPILE_FAILURE_STATUSES = [COMPILE_FAILED_AFTER_REPAIR, COMPILE_FAILED_AFTER_GENERATION]
RETRYABLE_STATUSES = [
    "COMPILE_FAILED_AFTER_REPAIR",
    "COMPILE_FAILED_AFTER_GENERATION",
    "COMPILE_FAILED",
    "API_FAILED",
    "GENERATION_FAILED",
    "TASK_CRASHED",
]
RETRYABLE_SYMPTOMS = ["COMPILE_FAILED", "API_FAILED", "GENERATION_FAILED"]

# --- fixed values: final categories, in report order -----------------------
CATEGORY_KILLED = "KILLED"
CATEGORY_SURVIVED = "SURVIVED"
CATEGORY_COMPILE_FAILED = "COMPILE_FAILED"
CATEGORY_OTHER = "OTHER"

# --- fixed values: mutation operators --------------------------------------
ONE_HOT_OPERATORS = [
    "AOIS", "SDL", "ROR", "AORB", "ODL", "LOI", "AOIU", "COI", "VDL", "CDL",
    "COR", "ASRS", "AORS", "COD", "LOR", "AODU", "AODS", "LOD", "SOR", "OTHER",
]
SIX_CLASSES = [
    "NUMERIC_EXPR",
    "RELATIONAL_BRANCH",
    "BOOLEAN_CONDITION",
    "BITWISE_SHIFT",
    "STATE_UPDATE_MISSING",
    "MIXED_DELETE_SIMPLIFY",
]
# class of each operator family in the feature vector
FEATURE_CLASS_MEMBERS = {
    "NUMERIC_EXPR": ["AORB", "AORS", "AOIS", "AOIU", "ASRS"],
    "RELATIONAL_BRANCH": ["ROR"],
    "BOOLEAN_CONDITION": ["COI", "COR"],
    "BITWISE_SHIFT": ["LOI", "LOR", "SOR"],
    "STATE_UPDATE_MISSING": ["SDL", "VDL"],
}
# class of each operator family in bucket keys; not the same mapping
BUCKET_CLASS_MEMBERS = {
    "NUMERIC_EXPR": ["AORB", "AORS", "AOIS", "AOIU", "AODU", "AODS", "ASRS", "CDL"],
    "RELATIONAL_BRANCH": ["ROR"],
    "BOOLEAN_CONDITION": ["COI", "COD", "COR"],
    "BITWISE_SHIFT": ["LOI", "LOR", "LOD", "SOR"],
    "STATE_UPDATE_MISSING": ["SDL", "VDL", "ODL"],
}
DEFAULT_CLASS = "MIXED_DELETE_SIMPLIFY"

# --- fixed values: failure texts -------------------------------------------
TIMEOUT_WORDS = ["time_out", "timed out", "timeout"]
INFRASTRUCTURE_WORDS = [
    "initializationerror",
    "classnotfoundexception",
    "noclassdeffounderror",
    "cannot create launcher without at least one testengine",
    "preconditionviolationexception",
    "worker protocol error",
    "worker exited with code",
    "worker timed out",
    "could not initialize class",
    "linkageerror",
    "loader constraint violation",
    "classformaterror",
    "unsupportedclassversionerror",
    "incompatibleclasschangeerror",
    "bootstrapmethoderror",
    "no such method error",
    "nosuchmethoderror",
    "no such field error",
    "nosuchfielderror",
    "verifyerror",
    "serviceconfigurationerror",
]
RUNNER_TIMEOUT_WORDS = ["mutant_total_timeout", "time_out", "timed out", "timeout"]
RUNNER_RESOURCE_WORDS = [
    "outofmemoryerror",
    "java heap space",
    "gc overhead limit exceeded",
    "metaspace",
    "stackoverflowerror",
]
RUNNER_STRICT_INFRASTRUCTURE_WORDS = [
    "loader constraint violation",
    "classnotfoundexception",
    "noclassdeffounderror",
    "worker_error:",
    "loadtestclass",
    "no tests discovered",
    "preconditionviolationexception",
    "cannot create launcher without at least one testengine",
]
RUNNER_INFRASTRUCTURE_WORDS = [
    "loader constraint violation",
    "linkageerror",
    "classnotfoundexception",
    "noclassdeffounderror",
    "exceptionininitializererror",
    "verifyerror",
    "bootstrapmethoderror",
    "worker_error:",
    "outofmemoryerror",
    "java heap space",
    "gc overhead limit exceeded",
    "metaspace",
]
ENVIRONMENT_WORDS = [
    "noclassdeffounderror",
    "classnotfoundexception",
    "unsupportedclassversionerror",
    "accessdeniedexception",
    "拒绝访问",
    "permission denied",
]

# --- fixed values: coarse compile-error categories, first match wins -------
# every inner list must be contained in the lower-case text; any alternative counts
COARSE_COMPILE_CATEGORIES = [
    ("方法调用歧义", [["reference to", "is ambiguous"]]),
    ("参数数量/类型不匹配", [["cannot be applied to given types"], ["actual and formal argument lists differ"]]),
    ("访问私有成员", [["has private access"]]),
    ("非public成员不可访问", [["is not public", "cannot be accessed"]]),
    ("找不到符号/方法", [["cannot find symbol"]]),
    ("类型不兼容", [["incompatible types"]]),
    ("无匹配方法重载", [["no suitable method found"]]),
    ("未处理受检异常", [["unreported exception"]]),
    ("泛型类型推断失败", [["cannot infer type arguments"]]),
    ("Override签名不匹配", [["method does not override or implement"]]),
    ("其他编译错误", [["error:"]]),
]
COARSE_COMPILE_NO_TEXT = "无错误文本"
COARSE_COMPILE_OTHER = "其他失败"

# --- fixed values: bandit actions, in tie-breaking order -------------------
EVIDENCE_ACTIONS = [
    "BASELINE",
    "MUTATION_HEAVY",
    "ENTRY_HEAVY",
    "COMPILE_HEAVY",
    "ASSERTION_HEAVY",
    "COMPACT",
]

# --- fixed values: phases ----------------------------------------------------
STRENGTHEN_ACTIONS = [
    "INPUT_STRENGTHEN",
    "ASSERTION_STRENGTHEN",
    "OBSERVABLE_SWITCH",
    "EXCEPTION_ORACLE",
    "REFERENCE_GUIDED_KILL",
    "TERMINATE",
]
ALLOWED_ACTIONS = {
    "NOT_GENERATED": ["INITIAL_GENERATION", "TERMINATE"],
    "GENERATED": ["INITIAL_GENERATION", "TERMINATE"],
    "COMPILED": ["INITIAL_GENERATION", "TERMINATE"],
    "ORIGINAL_PASSED": STRENGTHEN_ACTIONS,
    "TARGET_LIVE": STRENGTHEN_ACTIONS,
    "TARGET_KILLED": ["TERMINATE"],
    "COMPILE_FAILED": ["TERMINATE"],
    "ORIGINAL_FAILED": ["TERMINATE"],
    "TIMEOUT": ["TERMINATE"],
    "CRASHED": ["TERMINATE"],
    "EQUIVALENT_SUSPECTED": ["TERMINATE"],
}
PHASE_PROGRESS = {
    "TARGET_KILLED": 7,
    "ORIGINAL_PASSED": 3,
    "TARGET_LIVE": 2,
    "COMPILED": 2,
    "GENERATED": 1,
}

# --- fixed values: reward weights -------------------------------------------
REWARD = {
    "kill": 7.0,
    "compile": 0.5,
    "original_pass": 0.5,
    "survived": -2.5,
    "per_repair": -0.2,
    "per_prompt_char": -0.0001,
    "per_second": -0.001,
    "compile_failure": -4.0,
    "original_failure": -4.0,
    "timeout": -3.0,
}
TRANSITION_REWARD = {
    "compile_share": 0.25,
    "compile_cap": 0.5,
    "original_pass": 0.5,
    "kill": 7.0,
    "survived": -2.5,
    "not_compiled": -2.0,
    "original_failure": -3.0,
    "timeout": -3.0,
    "regression": -1.0,
}

# --- fixed values: visibility scales ----------------------------------------
VISIBILITY_QUERY = {"public": 60.0, "protected": 45.0, "package-private": 35.0, "": 0.0}
VISIBILITY_DERIVED = {"public": 100.0, "protected": 70.0, "package-private": 50.0, "": 10.0}
VISIBILITY_ACCESS = {"public": 100.0, "protected": 75.0, "": 50.0}

# --- fixed values: prompt budget defaults -----------------------------------
BUDGET = {
    "input_tokens": 10_000,
    "input_chars": 30_000,
    "output_tokens": 3_500,
    "hard_ratio": 3.0,
    "repair1_input": 1.80,
    "repair1_output": 1.45,
    "repair2_input": 2.60,
    "repair2_output": 2.30,
    "constructor_input": 1.20,
    "constructor_output": 1.20,
    "method_input": 1.10,
    "method_output": 1.10,
    "stub_input": 1.20,
    "stub_output": 1.30,
    "long_input": 1.25,
    "long_output": 1.25,
    "reasoning_output": 2.00,
}
BUDGET_CONSTRUCTOR_WORDS = ["constructor", "cannot be applied", "csvformat", "builder", "private access"]
BUDGET_METHOD_WORDS = ["cannot find symbol", "method"]
BUDGET_STUB_WORDS = ["abstract", "does not override", "overridden method is final", "super must be first statement"]
BUDGET_LONG_WORDS = ["[compilecp]", "[javac output]"]

# --- fixed values: files and tables -----------------------------------------
EXCLUDED_DIRECTORIES = ["test", "tests", "testdata", "test-data", "evosuite", "llm"]
GENERATION_COLUMNS = [
    "lineNo", "taskId", "compiled", "testSetName", "targetClassName", "methodSignature", "mutantName",
    "testJavaFile", "failureReason", "compileMillis", "compileRounds", "compileCalls", "repairRounds",
    "llmCalls", "llmMillis", "totalMillis", "generatedAt", "reportDir",
]
ROWS_PER_EXPORT_FILE = 500_000
FALLBACK_TESTS_PER_MUTANT = 50
WITNESSES_PER_MUTANT = 5
INT_MAX = 2_147_483_647

# --- fixed values: evidence profiles per action -----------------------------
PROFILE_LIMITS = {
    # action: (max chars, entry, method, field, graph list limits); -1 means no limit
    "BASELINE": (-1, -1, -1, -1, -1),
    "MUTATION_HEAVY": (18000, 2, 4, 4, 4),
    "ENTRY_HEAVY": (18000, 3, 3, 2, 3),
    "COMPILE_HEAVY": (14000, 1, 2, 2, 0),
    "ASSERTION_HEAVY": (16000, 2, 3, 3, 0),
    "COMPACT": (10000, 1, 2, 2, 0),
}

# --- fixed values: evidence sections per action -----------------------------
# sections that an action leaves out, whatever else it keeps
PROFILE_SECTIONS_LEFT_OUT = {
    "MUTATION_HEAVY": ["entryGraphEvidence", "entryEvidence", "liftedReachabilityPlan", "publicApiEvidence"],
    "ENTRY_HEAVY": ["mutationGraphEvidence", "mutationEvidence"],
    "COMPILE_HEAVY": [
        "mutationGraphEvidence", "entryGraphEvidence", "entryEvidence", "mutationEvidence", "liftedReachabilityPlan",
        "observableSelectionPlan", "inputDistinguishPlan", "propagationPlan",
    ],
    "ASSERTION_HEAVY": ["mutationGraphEvidence", "entryGraphEvidence", "entryEvidence", "publicApiEvidence"],
    "COMPACT": [
        "mutationGraphEvidence", "entryGraphEvidence", "entryEvidence", "publicApiEvidence", "mutationEvidence", "liftedReachabilityPlan",
    ],
}
# sections that an action keeps; an action that is not named here keeps all others
PROFILE_SECTIONS_KEPT = {
    "COMPILE_HEAVY": [
        "mutation", "entry", "executableTestPlan", "invocation", "assertions", "primaryChain", "alternativeChains", "compilationFacts",
        "entrySelection", "selectedEntry", "canonicalCore", "publicApiEvidence", "observablePlan", "mutationKillPlan",
        "observableDifferencePlan", "ripExecutionPlan", "entryChainPlan", "reachabilityGuardsPlan", "distinguishingInputGuidance",
        "indirectEntryTestPlan", "symbolicRipPlan", "symbolicFeasibility", "assertionPlan", "entryParameterControlPlan",
        "killabilityPlan", "evidenceQuality", "codeKbContext", "apiRoleFacts",
    ],
    "ASSERTION_HEAVY": [
        "mutation", "entry", "executableTestPlan", "invocation", "assertions", "primaryChain", "alternativeChains", "compilationFacts",
        "entrySelection", "selectedEntry", "canonicalCore", "observablePlan", "mutationKillPlan", "inputDistinguishPlan",
        "propagationPlan", "assertionPlan", "ripExecutionPlan", "observableDifferencePlan", "entryChainPlan", "reachabilityGuardsPlan",
        "distinguishingInputGuidance", "indirectEntryTestPlan", "symbolicRipPlan", "symbolicFeasibility", "observableSelectionPlan",
        "killabilityPlan", "evidenceQuality", "codeKbContext", "apiRoleFacts", "mutationEvidence",
    ],
    "COMPACT": [
        "mutation", "entry", "executableTestPlan", "invocation", "assertions", "primaryChain", "alternativeChains", "compilationFacts",
        "entrySelection", "selectedEntry", "canonicalCore", "observablePlan", "mutationKillPlan", "inputDistinguishPlan",
        "propagationPlan", "assertionPlan", "ripExecutionPlan", "observableDifferencePlan", "entryChainPlan", "reachabilityGuardsPlan",
        "distinguishingInputGuidance", "indirectEntryTestPlan", "symbolicRipPlan", "symbolicFeasibility", "observableSelectionPlan",
        "entryParameterControlPlan", "killabilityPlan", "evidenceQuality", "codeKbContext", "apiRoleFacts",
    ],
}

# --- fixed values: marks of a result matrix that take a mutant out of adequate sets
MUTANT_MARKS = ["y", "n", "?"]

# --- fixed values: texts of fallback witnesses and propagation reasons -----------
WITNESS_TEXTS = {
    "static_receiver": "No receiver object is required for static entry {signature}.",
    "constructor_receiver": "{owner} subject = new {owner}(/* constructor args */);",
    "live_receiver": "{owner} subject = /* construct a live receiver for {signature} */;",
    "no_predicates": "Shape the receiver so the mutation-sensitive branch can execute.",
    "predicates": "Satisfy the path predicates before the mutation-sensitive call.",
    "sink": "Observe the {kind} sink after invoking {call}.",
    "no_arguments": "No call arguments are required for {signature}; the witness depends on receiver state.",
    "argument": "{type} arg{number} = /* type-compatible value that preserves the path predicates */;",
    "keep_conditions": "Arguments should preserve the relevant conditions rather than short-circuiting the target branch.",
    "returned_value": "Choose argument values that make the returned value distinguish original from mutant.",
    "constructor_call": "new {owner}(/* args */)",
    "static_call": "{owner}.{name}(/* args */)",
    "instance_call": "subject.{name}(/* args */)",
    "original_outcome": "{kind} original outcome",
    "mutant_outcome": "different mutant outcome",
    "return_assertion": 'assertNotEquals("mutant should alter the returned value", /* originalExpected */, {call});',
    "other_assertion": "// Invoke {call} and assert the observable {expression} with a mutation-sensitive expectation.",
    "reason": "fallback witness built from ranked entry/observable candidates",
}
RETURN_REASON = "mutated method returns a value directly observable by the test"
PROPAGATION_TEXTS = {
    "access": "method {signature} {kind}s affected field '{field}'",
    "returns": "non-void return can expose propagated state",
    "visible": "{visibility} visibility makes it a better test entry than private helpers",
}

# --- fixed values: how a profile shortens the parts of evidence -----------------
# k is the action's graph list limit; lists keep max(least, k + more) items, or `least` where more is None
# (section, list, least, more, characters of an item)
EVIDENCE_LISTS = [
    ("entry", "callChain", 4, None, 180),
    ("executableTestPlan", "supportClasses", 1, 0, 800),
    ("executableTestPlan", "requiredSetup", 2, 1, 240),
    ("executableTestPlan", "forbidden", 2, 1, 180),
    ("invocation", "imports", 4, 3, 160),
    ("invocation", "setup", 2, 1, 220),
    ("assertions", "requiredToKill", 1, 0, 260),
    ("assertions", "optionalSanityChecks", 1, 0, 200),
    ("assertions", "mutationSensitiveObservables", 2, 1, 200),
    ("assertions", "auxiliaryObservables", 1, 0, 180),
    ("assertions", "avoid", 2, 1, 180),
    ("publicApiEvidence", "availablePublicMethods", 2, 1, 200),
    ("publicApiEvidence", "availableSetupMethods", 2, 1, 200),
    ("publicApiEvidence", "stateSetupPlan", 2, 1, 220),
    ("publicApiEvidence", "antiPatterns", 2, 1, 180),
    ("publicApiEvidence", "compilationGuardrails", 2, 1, 180),
    ("mutationEvidence", "originAffected", 4, None, 160),
    ("mutationEvidence", "mutantAffected", 4, None, 160),
    ("mutationGraphEvidence", "availableEvidenceKinds", 2, 1, 120),
    ("entryGraphEvidence", "availableEvidenceKinds", 2, 1, 120),
]
# (section, text, characters)
EVIDENCE_TEXTS = [
    ("entry", "entryMethodSignature", 300),
    ("entry", "recommendedTarget", 160),
    ("executableTestPlan", "entryCall", 400),
    ("invocation", "call", 400),
    ("mutationEvidence", "originCode", 500),
    ("mutationEvidence", "mutantCode", 500),
    ("mutationEvidence", "propagationHint", 220),
    ("codeKbContext", "summary", 260),
] + [
    (section, name, chars)
    for section in ("mutationGraphEvidence", "entryGraphEvidence")
    for name, chars in (
        ("role", 220), ("path", 320), ("originPathSummary", 320), ("mutantPathSummary", 320),
        ("callSiteToMutation", 260), ("entryPathSummary", 320),
    )
]
# (section, object, items of its lists or None for k, characters of its texts)
EVIDENCE_OBJECTS = [
    ("executableTestPlan", "branchReachability", 4, 220),
    ("executableTestPlan", "observable", 4, 220),
    ("invocation", "receiver", 8, 260),
    ("publicApiEvidence", "branchReachabilityPlan", 4, 220),
] + [
    (section, name, None, 220)
    for section in ("mutationGraphEvidence", "entryGraphEvidence")
    for name in ("originGraph", "mutantGraph", "originEntryGraph")
]
# lists of objects: (list, which limit, members of an object, characters of a member)
EVIDENCE_CONTEXT_LISTS = [
    ("candidateEntries", "entry", 5, 220),
    ("mutantMethodCalls", "method", 4, 180),
    ("mutantFieldAccesses", "field", 4, 180),
    ("affectedFields", "field", 6, 160),
    ("fieldPropagationCandidates", "entry", 6, 220),
]
# plans: all lists keep max(floor, k) items, those of inner objects one less; texts keep 220 characters
EVIDENCE_PLANS = {
    2: [
        "observablePlan", "mutationKillPlan", "inputDistinguishPlan", "propagationPlan", "assertionPlan", "ripExecutionPlan",
        "observableSelectionPlan", "entryParameterControlPlan", "killabilityPlan", "liftedReachabilityPlan", "evidenceQuality", "apiRoleFacts",
    ],
    3: [
        "primaryChain", "entrySelection", "selectedEntry", "compilationFacts", "observableDifferencePlan", "entryChainPlan",
        "reachabilityGuardsPlan", "distinguishingInputGuidance", "indirectEntryTestPlan", "symbolicRipPlan", "symbolicFeasibility",
    ],
}
EVIDENCE_PLAN_CHARS = 220
# (most items, characters of an item) of alternativeChains: by the profile, and above the character limit
EVIDENCE_CHAINS = (2, 400)
EVIDENCE_CHAINS_OVER = (1, 360)
# above the character limit: k of these sections, context limits, plans that are cut to their floor once more
EVIDENCE_OVER_K = {"mutationGraphEvidence": 1, "entryGraphEvidence": 1, "executableTestPlan": 2, "invocation": 2, "assertions": 2}
EVIDENCE_OVER_CONTEXT = {"entry": 1, "method": 1, "field": 1}
EVIDENCE_OVER_PLANS = {
    2: ["mutationKillPlan", "inputDistinguishPlan", "propagationPlan", "assertionPlan", "ripExecutionPlan", "entryParameterControlPlan"],
    3: EVIDENCE_PLANS[3],
}
# sections that go, tier by tier, while the rest is still too long
EVIDENCE_TIERS = [
    ["entryGraphEvidence", "mutationGraphEvidence"],
    ["publicApiEvidence", "entryEvidence", "mutationEvidence"],
    ["observableSelectionPlan", "liftedReachabilityPlan"],
]

# --- fixed values: compile-error kinds, first match wins --------------------
# (label, alternatives); all words of one alternative must occur in the lower-case text
COMPILE_ERROR_KINDS = [
    ("LLM_OUTPUT_TRUNCATED", [["finish_reason=length"], ["output truncated"]]),
    ("EMPTY_LLM_CONTENT", [["empty visible content"], ["reasoning_content only"]]),
    ("EXPECTED_CLASS_NOT_FOUND", [["expected class file not found"]]),
    (
        "VOID_VALUE_MISUSE",
        [["void cannot be converted"], ["void type not allowed here"], ["incompatible types: void"], ["not a statement"]],
    ),
    (
        "DATAINPUT_ANONYMOUS_STUB",
        [
            ["datainput", "does not override"],
            ["datainput", "readline"],
            ["datainput", "is not abstract"],
            ["datainput", "missing"],
        ],
    ),
    ("ABSTRACT_STUB_INCOMPLETE", [["does not override abstract method"]]),
    ("OVERRIDE_ACCESS_WEAKENING", [["weaker access privileges"]]),
    (
        "OVERRIDE_FORBIDDEN_OR_SIGNATURE",
        [
            ["method does not override or implement a method from a supertype"],
            ["overridden method is final"],
            ["cannot override"],
        ],
    ),
    (
        "INVENTED_GETTER_OR_API",
        [
            ["cannot find symbol", "getwidth("],
            ["cannot find symbol", "getheight("],
            ["cannot find symbol", "getignore("],
        ],
    ),
    ("UNDEFINED_VARIABLE_OR_SETUP_MISMATCH", "VARIABLE_SYMBOL"),
    ("PRIVATE_ACCESS", [["private access"]]),
    ("PROTECTED_ACCESS", [["has protected access"]]),
    ("PACKAGE_PRIVATE_ACCESS", [["is not public"], ["cannot be accessed from outside package"]]),
    ("CONSTRUCTOR_MISMATCH", [["constructor", "cannot be applied"], ["constructor", "undefined"]]),
    ("ABSTRACT_INSTANTIATION", [["cannot be instantiated"], [" is abstract"]]),
    ("METHOD_ARGUMENT_MISMATCH", [["method", "cannot be applied to given types"]]),
    ("METHOD_NOT_FOUND", [["cannot find symbol", "method"]]),
    (
        "CHECKED_EXCEPTION_NOT_HANDLED",
        [
            ["unreported exception", "must be caught or declared to be thrown"],
            ["exception", "is never caught", "declared to be thrown"],
        ],
    ),
    ("MISSING_CLASS_OR_IMPORT", [["cannot find symbol"]]),
    (
        "INCOMPATIBLE_TYPES",
        [["incompatible types"], ["no suitable method found"], ["reference to assertequals is ambiguous"]],
    ),
]
VARIABLE_SYMBOL_PATTERN = r"symbol:\s+variable\s"
