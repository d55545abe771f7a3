"""Row types of run stores. Times are epoch milliseconds; missing is null, never 0."""

RUNS = (
    "runId string, scenarioId string, variantId string, datasetVersion string, codeSha string, promptSha string, modelFingerprint string,"
    " seed double, parentRunId string, projectId string, chatId string, layer string, startedAt bigint, endedAt bigint, status string,"
    " outcome struct<score:double,pass:boolean,failureClass:string,notes:string>, budget struct<tokens:double,wallMs:double,calls:double,usd:double>,"
    " tags map<string,string>"
)
SPANS = (
    "spanId string, parentSpanId string, runId string, kind string, name string, startedAt bigint, endedAt bigint, status string, error string,"
    " model string, messages array<struct<role:string,content:string>>, output string, inputTokens double, outputTokens double, cachedTokens double, costUsd double,"
    " toolName string, args string, result string, latencyMs double, judgeId string, targetSpanId string, dimension string, score double, rationale string"
)
EVENTS = "eventId string, runId string, spanId string, kind string, timestamp bigint, payload string"
RUN_RECORDS = (
    "runId string, experimentId string, candidateId string, seed double, model string, promptHash string, configHash string, commitSha string,"
    " wallMs double, costUsd double, costProvenance struct<kind:string,usd:double>,"
    " tokenUsage struct<input:double,output:double,reasoning:double,cached:double,cacheWrite:double>, terminalOutcome string,"
    " outcome struct<searchScore:double,holdoutScore:double,raw:map<string,double>,realness:struct<score:double,gated:boolean,reason:string>>,"
    " failureClass string, failureMode string, splitTag string, scenarioId string"
)
OUTCOMES = "runId string, capturedAt bigint, metrics map<string,double>"
ROLLOUTS = (
    "rollout_id string, parent_rollout_id string, instance string, split string, status string, reward double, gated boolean,"
    " messages array<struct<role:string,content:string>>, completion string"
)
FLAT_SPANS = (
    "trace_id string, span_id string, parent_span_id string, name string, kind string, start_time string, end_time string,"
    " status struct<code:string,message:string>, resource struct<attributes:map<string,string>>, attributes map<string,string>"
)
EXPORT = (
    "resourceSpans array<struct<resource:struct<attributes:array<struct<key:string,value:struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>>>>,"
    "scopeSpans:array<struct<spans:array<struct<traceId:string,spanId:string,parentSpanId:string,name:string,startTimeUnixNano:string,endTimeUnixNano:string,"
    "status:struct<code:string,message:string>,attributes:array<struct<key:string,value:struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>>>>>>>>>"
)
