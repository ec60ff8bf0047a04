"""Document extraction, template validation and review analytics on Spark DataFrames."""

from fieldmill.catalogue import Catalogue, Template, TemplateField

__all__ = ["Catalogue", "Template", "TemplateField"]
