"""The documents as Spark types: DDL of each part, for reading valid documents into columns. Absent optional members are null.

The parts of a union (origins, anchors, values, claims, timings) are one struct with the members of all kinds, told apart by their tag.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed names of the format.
DIGEST = "struct<algorithm:string,value:string>"
SPAN = "struct<start:bigint,end:bigint>"
ORIGIN = "struct<kind:string,url:string,fixtureId:string>"
REGION = "struct<unit:string,x:double,y:double,width:double,height:double>"
ANCHOR = f"struct<kind:string,page:int,block:int,region:{REGION},characterStart:bigint,characterEnd:bigint,url:string,selector:string>"
EXTRACTION = "struct<method:string,engine:string,version:string,extractedAt:string>"
SOURCE = f"struct<id:string,displayName:string,kind:string,mediaType:string,byteSize:bigint,pageCount:int,origin:{ORIGIN}>"
REVISION = f"struct<id:string,sourceId:string,fingerprint:{DIGEST},createdAt:string,status:string,supersedesRevisionId:string>"
SEGMENT = f"struct<id:string,sourceId:string,sourceRevisionId:string,index:int,text:string,anchor:{ANCHOR},extraction:{EXTRACTION}>"
CONTEXT = f"struct<sources:array<{SOURCE}>,sourceRevisions:array<{REVISION}>,sourceSegments:array<{SEGMENT}>>"

EVIDENCE = f"struct<sourceId:string,sourceRevisionId:string,segmentId:string,quote:string,span:{SPAN}>"
VALUE = "struct<kind:string,value:string,amount:string,currency:string,basis:string,unit:string>"
ALTERNATIVE = f"struct<statement:string,evidence:array<{EVIDENCE}>>"
CLAIM_CHECKS = "struct<citation:string,semanticSupport:string>"
ACTION_CHECKS = "struct<basis:string,timing:string,safety:string>"
VALIDATION = "struct<state:string,validatorVersion:string,validatedAt:string,issueCodes:array<string>,checks:{checks}>"
CLAIM = (
    f"struct<id:string,provenance:string,title:string,statement:string,materiality:string,normalizedValues:array<{VALUE}>,evidence:array<{EVIDENCE}>,basisClaimIds:array<string>,rationale:string,reason:string,"
    f"sourceImposed:boolean,execution:string,alternatives:array<{ALTERNATIVE}>,validation:{VALIDATION.format(checks=CLAIM_CHECKS)}>"
)
TIMING = "struct<kind:string,date:string,label:string,basisClaimId:string>"
ACTION = (
    "struct<id:string,provenance:string,order:int,priority:string,title:string,description:string,basisClaimIds:array<string>,requiredInputs:array<string>,sourceImposed:boolean,execution:string,"
    f"timing:{TIMING},consequence:struct<text:string,basisClaimIds:array<string>>,validation:{VALIDATION.format(checks=ACTION_CHECKS)}>"
)
QUESTION = "struct<id:string,text:string,reason:string,basisClaimIds:array<string>>"
POINTERS = "struct<documentType:string,titleClaimId:string,purposeClaimId:string,actionRequiredClaimId:string,nearestDeadlineClaimId:string,primaryActionId:string>"
SECTIONS = "struct<briefClaimIds:array<string>,factClaimIds:array<string>,attentionClaimIds:array<string>,missingInformationClaimIds:array<string>,conflictClaimIds:array<string>,planActionIds:array<string>>"
ANALYSIS = f"struct<kind:string,schemaVersion:string,analysisId:string,knowledgeMode:string,sourceRevisionIds:array<string>,document:{POINTERS},claims:array<{CLAIM}>,actions:array<{ACTION}>,questions:array<{QUESTION}>,sections:{SECTIONS}>"

EVENT = "struct<id:string,sequence:int,occurredAt:string,type:string,status:string,actor:struct<location:string,name:string>,relatedId:string>"
_SCOPE = "recipient:string,provider:string,model:string,sourceRevisionIds:array<string>,segmentIds:array<string>,contentCategories:array<string>,redactions:array<string>"
CONSENT = f"struct<id:string,recordedAt:string,approvedBy:string,previewDigest:{DIGEST},{_SCOPE}>"
POLICY = "struct<retention:string,trainingUse:string,assertedBy:string,policyUrl:string>"
TRANSFER = f"struct<id:string,consentId:string,startedAt:string,completedAt:string,executionLocation:string,payloadDigest:{DIGEST},payloadByteCount:bigint,providerPolicy:{POLICY},{_SCOPE}>"
RETENTION = "struct<id:string,subject:string,state:string,assertedBy:string,recordedAt:string,eventId:string>"
COMPONENT = "struct<component:string,name:string,version:string>"
SUMMARY = "struct<totalClaims:int,accepted:int,needsReview:int,blocked:int,stale:int,totalActions:int,acceptedActions:int,needsReviewActions:int,blockedActions:int,staleActions:int>"
REFERENCE = "struct<id:string,url:string,title:string,accessedAt:string>"
RECEIPT = f"struct<id:string,createdAt:string,processingMode:string,events:array<{EVENT}>,consentRecords:array<{CONSENT}>,transfers:array<{TRANSFER}>,retention:array<{RETENTION}>,components:array<{COMPONENT}>,validationSummary:{SUMMARY},externalReferences:array<{REFERENCE}>,correctionIds:array<string>>"
CORRECTION = f"struct<id:string,sourceId:string,priorRevisionId:string,targetSegmentId:string,targetSpan:{SPAN},originalText:string,replacement:string,actor:string,createdAt:string,resultingRevisionId:string,invalidatedClaimIds:array<string>,regeneratedClaimIds:array<string>>"
PACK = f"struct<kind:string,schemaVersion:string,packId:string,createdAt:string,runMode:string,canonicalSources:{CONTEXT},analysis:{ANALYSIS},receipt:{RECEIPT},corrections:array<{CORRECTION}>,limitations:array<string>>"
PROGRESS = "struct<actionId:string,state:string,updatedAt:string>"
ISSUE = "struct<key:string,path:string,code:string,message:string>"


def typed(docs: DataFrame, schema: str, column: str = "raw") -> DataFrame:
    """docs with the document of a column of JSON text as a struct beside it, called doc. Text that is no JSON gives null."""
    return docs.withColumn("doc", F.from_json(F.col(column), schema))
