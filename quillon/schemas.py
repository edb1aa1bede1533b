"""Explicit schemas of the engine's tables; nothing is inferred from data."""

from __future__ import annotations

QA_EXAMPLE = (
    "id string, source string, question string, question_type string, answer string, context string, long_answer string, ideal_answer string, "
    "snippets array<struct<id:string,text:string,document:string>>, gold_passage_ids array<string>"
)
MCQ_EXAMPLE = "id string, source_dataset string, question string, options array<struct<label:string,text:string>>, answer string, subject string"
PASSAGE = "id string, text string, source string, metadata map<string,string>, ord bigint"
PASSAGE_VECTOR = "id string, embedding array<float>"
GENERATED = (
    "question_id string, question string, question_type string, gold_answer string, mode string, "
    "passages array<struct<id:string,text:string,is_gold:boolean,position:int>>, generated_reasoning string, generated_answer string, "
    "input_tokens int, output_tokens int, cost_estimate double"
)
TRAIN_RECORD = (
    "recipe string, example_id string, prompt string, target string, "
    "metadata struct<mode:string,question_type:string,gold_disagreement:string,gold_answer:string,generated_answer:string>"
)
PREDICTION = "example_id string, model string, retrieval string, seed int, predicted string, gold string, confidence double, question_type string"
ANNOTATION = (
    "example_id string, cell_name string, question string, passages string, gold_answer string, model_answer string, model_reasoning string, "
    "is_correct boolean, error_categories array<string>, notes string, annotator string, timestamp string"
)
#: Raw documents of question files: the polymorphic fields are kept as JSON text and taken apart by ``variant`` functions.
QUESTION = "id string, body string, type string, exact_answer variant, ideal_answer variant, snippets array<struct<text:string,document:string>>"
QUESTION_FILE = "questions array<struct<id:string,body:string,type:string,exact_answer:variant,ideal_answer:variant,snippets:array<struct<text:string,document:string>>>>"
