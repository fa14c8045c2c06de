"""Schemas of the records that cross a boundary (files, evaluator, artifacts)."""

SECTION = "struct<heading:string,element:string,text:string>"
LINK = "struct<href:string,text:string,placement:string>"
REPOSITORY_SOURCE = (
    "struct<path:string,blob_sha:string,extraction:string,provider:string,repository:string,ref:string,"
    "commit_sha:string>"
)

# What HTML, Markdown or component source yields.
CAPTURE = (
    f"struct<title:string,meta_description:string,canonical_url:string,language:string,"
    f"headings:array<string>,breadcrumbs:array<string>,links:array<{LINK}>,sections:array<{SECTION}>>"
)

# The page-bundle file: camel case, because that is the file's contract.
BUNDLE = (
    "schemaVersion string, primaryUrl string, observedAt string, "
    "acquisition struct<method:string,sourceName:string,ownerAuthorized:boolean>, "
    "pages array<struct<url:string,title:string,canonicalUrl:string,metaDescription:string,language:string,"
    "observedAt:string,partialCoverage:boolean,headings:array<string>,breadcrumbs:array<string>,"
    f"sections:array<{SECTION}>,links:array<{LINK}>,"
    "archive:struct<collection:string,timestamp:string,recordUrl:string,digest:string,originalUrl:string,"
    "selectedSource:string,sourceDisagreement:boolean>,"
    "repositorySource:struct<path:string,blobSha:string,extraction:string,provider:string,repository:string,"
    "ref:string,commitSha:string>>>"
)
MANIFEST = (
    "schemaVersion string, primaryUrl string, sourceName string, observedAt string, "
    "pages array<struct<url:string,file:string>>"
)

CHUNK = "struct<kind:string,index:int,label:string,text:string>"
MESSAGE = (
    "struct<message_id:string,category:string,text:string,audiences:array<string>,proof:array<string>,"
    "source_location:struct<kind:string,index:int,label:string>,source_excerpt:string>"
)

AFFECTED_SECTION = (
    "struct<heading:string,current_excerpt:string,message_ids:array<string>,message_excerpt:string,"
    "action:string,guidance:string>"
)
EVALUATION = (
    "struct<page_id:string,page_type:string,audience_role:string,funnel_role:string,status:string,"
    "messaging_impact:double,audience_relevance:double,funnel_importance:double,proof_gap:double,"
    f"update_efficiency:double,affected_sections:array<{AFFECTED_SECTION}>,rationale:string,"
    "confidence:string,human_review_required:boolean>"
)
REVIEW = "struct<role:string,decision:string,rationale:string,issue_codes:array<string>>"

CACHE = (
    "input_digest string, model_digest string, provider_config string, contract_version string, "
    "approval_gate_version string, created_at timestamp, evaluation_digest string, "
    f"evaluation {EVALUATION}, reviews array<{REVIEW}>"
)
LEDGER = (
    "input_digest string, attempt int, mode string, model_digest string, provider_config string, "
    "created_at timestamp, evaluation_digest string, "
    f"evaluation {EVALUATION}, gate_status string, reviews array<{REVIEW}>"
)
EFFECT = (
    "struct<retry_authorized:boolean,authorized_ledger_attempt:int,cache_approval_bypassed:boolean,"
    "manual_use_only:boolean,reusable_cache_eligible:boolean,publication_approval:boolean,"
    "quarantine_confirmed:boolean>"
)
QUEUE_ITEM = (
    "input_digest string, model_digest string, page_id string, url string, title string, priority string, "
    "rejection_attempt int, evaluation_digest string, "
    "rejections array<struct<role:string,rationale:string,issue_codes:array<string>>>, "
    "decision string, adjudicator string, adjudicator_role string, rationale string"
)
ADJUDICATION = (
    "created_at timestamp, queue_created_at timestamp, run_id string, input_digest string, "
    "model_digest string, rejection_attempt int, evaluation_digest string, page_id string, url string, "
    f"decision string, adjudicator string, adjudicator_role string, rationale string, effect {EFFECT}, "
    "record_digest string"
)
