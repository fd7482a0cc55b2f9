"""What each issue code means. The codes are fixed values."""

from __future__ import annotations

_TEXT = """
invalid_type | The value has the wrong type.
unknown_field | The object has a member that its schema does not know.
too_few_items | The list is too short.
too_many_items | The list is too long.
string_too_short | The text is too short.
string_too_long | The text is too long.
control_character | The text has control characters.
active_content | The text has markup or script in it.
invalid_id | This is no stable identifier.
invalid_token | This is no lower-case token.
invalid_enum | The value is none of those allowed.
invalid_literal | The value differs from the only one allowed.
invalid_integer | This is no safe integer.
integer_out_of_range | The integer is out of its range.
invalid_number | This is no finite number.
number_out_of_range | The number is out of its range.
invalid_timestamp | This is no ISO 8601 date-time.
invalid_date | This is no real date as YYYY-MM-DD.
url_credentials | The URL carries credentials.
invalid_url | This is no absolute HTTP or HTTPS URL.
invalid_digest | This is no lower-case SHA-256 digest.
duplicate_id | The value repeats an earlier one.
invalid_media_type | This is no media type.
invalid_decimal_amount | This is no plain decimal amount.
invalid_currency | This is no three-letter currency code.
origin_mismatch | A URL source has an origin of another kind.
region_out_of_bounds | The region reaches beyond its page.
invalid_span | The span does not start before it ends.
dangling_source | No source has this id.
dangling_revision | No revision has this id.
revision_source_mismatch | The superseded revision is of another source.
revision_cycle | The revision supersedes itself.
segment_revision_mismatch | The segment and its revision are of different sources.
duplicate_segment_index | Another segment of the revision has this index.
page_out_of_bounds | The page is beyond the end of its source.
ocr_region_required | Recognised text needs the region of its page.
revision_not_analyzed | The analysis does not cover this revision.
dangling_segment | No segment has this id.
stale_revision | The revision is not the active one.
evidence_source_mismatch | Source, revision and segment do not belong together.
span_out_of_bounds | The span reaches beyond its segment.
quote_mismatch | The quote is not what stands at its span.
accepted_with_issues | What is accepted cannot have issue codes.
missing_issue_code | What is not accepted needs an issue code.
unsupported_state | An open or conflicting claim cannot be accepted.
accepted_without_citation_check | An accepted claim needs a passed citation check.
accepted_without_semantic_support | An accepted fact needs semantic support.
invalid_suggestion_support_check | Semantic support does not apply to suggestions.
suggestion_not_source_imposed | A suggestion claims to be imposed by its source.
conflict_needs_distinct_evidence | A conflict needs evidence from two segments.
asserted_value_not_allowed | This kind of claim cannot assert values.
accepted_without_basis_check | An accepted action needs a passed basis check.
accepted_without_safety_check | An accepted action needs a passed safety check.
accepted_without_timing_check | An accepted action needs the timing check of its kind.
requirement_not_source_imposed | A requirement must be imposed by its source.
suggestion_source_imposed | A suggested action cannot be imposed by a source.
dangling_claim | No claim has this id.
blocked_claim_reference | The claim is blocked or stale.
invalid_inference_basis | An inference rests on something other than facts and inferences.
suggestion_chain | A suggestion rests on a suggestion.
claim_cycle | Inferences depend on each other in a circle.
requirement_needs_source_fact | A requirement rests on something other than a stated fact.
timing_basis_missing | The timing claim is not among the bases of the action.
date_needs_source_fact | A calendar date needs a stated fact.
timing_value_mismatch | The date is none that its claim states.
invalid_document_pointer | The pointer leads to a suggestion.
invalid_deadline_pointer | The deadline is neither a fact nor an inference.
dangling_action | No action has this id.
blocked_action_reference | The action is blocked or stale.
suggestion_in_brief | The brief has a suggestion in it.
wrong_section_provenance | Claims of this kind have no place in the section.
related_id_required | The event does not say what it is about.
event_order | The sequence does not rise.
event_time_order | The time moves backwards.
receipt_time_order | The receipt is older than its last event.
analysis_event_missing | No completed analysis event is on record.
validation_event_missing | No completed validation event is on record.
untrusted_validation_actor | A provider cannot attest its own output.
validation_before_analysis | The validation comes before the analysis.
validation_time_mismatch | A record was validated at another time than the event says.
consent_event_missing | No completed event backs the consent.
consent_event_time_mismatch | The consent and its event differ in time.
transfer_without_consent | No consent backs the transfer.
consent_mismatch | The transfer differs from what was consented to.
payload_digest_mismatch | The payload is not the one previewed.
transfer_before_consent | The transfer starts before the consent.
transfer_event_missing | No completed event backs the start of the transfer.
transfer_event_time_mismatch | The transfer and its event differ in time.
transfer_completion_required | The transfer is not complete.
transfer_time_order | The transfer ends before it starts.
transfer_completion_event_missing | No completed event backs the end of the transfer.
transfer_actor_mismatch | The transfer ended in another place than it was executed.
transfer_event_order | The end of the transfer is not after its start.
unexpected_external_transfer | Local processing has no transfers.
missing_external_transfer | Cloud processing has a transfer.
redacted_mode_content_mismatch | Redacted processing sends unredacted content.
redacted_mode_disclosure_missing | Redacted processing does not disclose its redactions.
full_mode_content_mismatch | Full processing does not say what it sends.
receipt_revision_mismatch | The revision is outside the analysis.
receipt_segment_mismatch | The record names an unknown segment.
receipt_segment_revision_mismatch | The segment is of a revision that the record does not name.
retention_event_required | This state needs an observed event.
dangling_event | No event has this id.
retention_event_mismatch | The event is of another kind than the state needs.
retention_event_not_completed | An event that failed proves nothing.
retention_event_time_mismatch | The record and its event differ in time.
retention_actor_mismatch | The event has the wrong actor for this state.
retention_subject_mismatch | The event is about something else.
product_version_missing | The main component is not named.
validator_version_missing | The citation validator is not named.
external_reference_in_source_only_mode | Analysis of sources only has outside references.
summary_mismatch | The declared count is not the counted one.
prior_revision_not_superseded | The corrected revision is not marked superseded.
resulting_revision_not_active | The resulting revision is not active.
correction_revision_mismatch | The two revisions are no chain of one source.
correction_source_mismatch | The revision is of another source.
unchanged_revision_fingerprint | The correction changes nothing.
correction_segment_mismatch | The segment is not of the corrected revision.
correction_text_mismatch | The original text is not what stands at the span.
regenerated_claim_revision_mismatch | The claim does not cite the resulting revision.
correction_event_missing | No completed event backs the correction.
correction_event_time_mismatch | The correction and its event differ in time.
correction_actor_mismatch | The correction was not made on the user's side.
pack_time_order | The document is older than its receipt.
correction_receipt_mismatch | The receipt lists other corrections.
run_mode_mismatch | The run mode and the processing mode disagree.
parser_exception | The input cannot be read.
"""

MESSAGES = dict(line.split(" | ") for line in _TEXT.strip().splitlines())
