"""Training-data operators. Nothing else in quillframe imports this subpackage."""
