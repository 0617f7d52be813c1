"""Column builders: pure functions from columns to columns, all inside whole-stage codegen."""
