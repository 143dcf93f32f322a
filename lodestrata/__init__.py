"""lodestrata: versioned-evidence analytics expressed as Spark DataFrame plans."""
