"""The queries over the driver's tables, with their SQL."""


def registries() -> list:
    """The registries of the core, in order."""
    from veritrail.plans import audits, data_problems, evidence, governance, manifests, shapes

    return [module.registry for module in (data_problems, evidence, manifests, governance, shapes, audits)]
