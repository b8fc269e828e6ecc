"""Closed domains of the discourse-graph model, in their canonical order."""

# Fixed values.
SECTIONS = ("Abstract", "Introduction", "Method", "Experiment", "Results", "Discussion", "Conclusion", "Other")
FUNCTIONS = ("Motivation", "Claim", "Evidence", "Background", "Definition", "MethodStep", "Observation", "Attribution", "Concession", "Compensation", "Specific", "Generalization", "Restatement", "MetaDiscourse", "Other")
RST_TYPES = ("Elaboration", "Background", "Cause", "Result", "Contrast", "Concession", "Evidence", "Justify", "Motivation", "Solutionhood", "Sequence", "Restatement", "Summary", "Condition", "Other")
ENTITY_TYPES = ("Concept", "Method", "Metric", "Dataset", "Model", "Task", "Claim", "Other")
SEVERITIES = ("high", "medium", "low")
VERDICTS = ("correct", "wrong", "partial")
#: Rules of the cross-section pass.
CROSS_SECTION_RULES = ("REL-04", "REL-08", "REL-12")
#: USD for a million input, output and cached input tokens, by model.
PRICES = {"large-heavy": (15.0, 75.0, 1.5), "mid": (3.0, 15.0, 0.3), "small-light": (0.8, 4.0, 0.08)}
