"""Readers and writers: JSON Lines records, samples, predictions, transcripts and file manifests."""

from tallyforge.sources.files import file_manifest
from tallyforge.sources.lines import numbered_lines
from tallyforge.sources.predictions import last_prediction, read_predictions
from tallyforge.sources.records import ingest_jsonl_records, read_records
from tallyforge.sources.samples import read_eval_samples, sample_from_payload
from tallyforge.sources.transcripts import write_transcripts

__all__ = [
    "file_manifest",
    "ingest_jsonl_records",
    "last_prediction",
    "numbered_lines",
    "read_eval_samples",
    "read_predictions",
    "read_records",
    "sample_from_payload",
    "write_transcripts",
]
