"""Work tables in the cluster's shared folder; see :mod:`hopflux.plans.work`."""

from hopflux.plans.work import Scope, bucketed, current, save, scope, shared_dir, within

__all__ = ["Scope", "bucketed", "current", "save", "scope", "shared_dir", "within"]
