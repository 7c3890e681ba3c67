"""quillframe: analytics over long structured documents, written as Spark DataFrame plans."""
