"""Conditional rules as data.

A rule is a row: one or more conditions (any may hold), and what happens when it is the first rule
that holds. Conditions read the token and the row as the fold has left it so far; the compiler in
``operators.normalize`` turns each table into a literal that is looked up by token.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from provender.errors import RuleError


def _words(value) -> tuple[str, ...]:
    return (value,) if isinstance(value, str) else tuple(value)


@dataclass(frozen=True)
class When:
    """All given parts must hold. ``lists`` and ``type_lists`` name vocabularies."""

    tokens: tuple[str, ...] | str = ()
    lists: tuple[str, ...] | str = ()
    group: tuple[str, ...] | str = ()
    category: tuple[str, ...] | str = ()
    type: tuple[str, ...] | str = ()
    type_lists: tuple[str, ...] | str = ()
    first_subtype: tuple[str, ...] | str = ()
    not_group: tuple[str, ...] | str = ()
    not_category: tuple[str, ...] | str = ()
    not_type: tuple[str, ...] | str = ()

    def __post_init__(self):
        for name in self.__dataclass_fields__:
            object.__setattr__(self, name, _words(getattr(self, name)))


@dataclass(frozen=True)
class Rule:
    """First match wins.

    ``rename``: the token goes on under another name. ``drop``: the token is used up.
    ``retype``: the Basic Type becomes the token (True) or the given word; the token is used up.
    ``assign``: columns overwritten. ``add``: sub-types added, in front when ``front``.
    With none of these the token goes on as it is and later rules are not tried.
    """

    name: str
    when: tuple[When, ...] | When
    rename: str | None = None
    drop: bool = False
    retype: bool | str = False
    assign: dict[str, str] = field(default_factory=dict)
    add: tuple[str, ...] = ()
    expand: dict[str, list[str]] = field(default_factory=dict)
    front: bool = False

    def __post_init__(self):
        if isinstance(self.when, When):
            object.__setattr__(self, "when", (self.when,))


def rule_to_dict(rule: Rule) -> dict:
    """A rule as plain values, without the fields that are empty."""
    value = {k: v for k, v in asdict(rule).items() if v}
    value["when"] = [{k: list(v) for k, v in when.items() if v} for when in value["when"]]
    return value


def rule_from_dict(value: dict) -> Rule:
    """What :func:`rule_to_dict` gave; unknown fields are an error."""
    try:
        given = {**value, "add": tuple(value.get("add", ()))}
        return Rule(**{**given, "when": tuple(When(**when) for when in value["when"])})
    except (TypeError, KeyError) as error:
        raise RuleError(f"rule {value.get('name')!r}: {error}") from error


# The words and effects of the rules below.
# Rules on every token after the first, before it is placed.
TOKEN_RULES: tuple[Rule, ...] = (
    Rule(
        "token is the basic type",
        (When("bar", type="snack"), When("watercress", type="herb")),
        retype=True,
    ),
    Rule(
        "always allowed",
        (
            When("blue", type="cheese"),
            When("instant", group="Beverages"),
            When("black", type=("tea", "drink")),
            When("gluten free", first_subtype="parfait"),
        ),
    ),
    Rule(
        "not allowed",
        (
            When(("in brine", "nectar", "honey"), group="Milk & Dairy"),
            When(("ketchup", "italian"), group="Meat"),
            When(("whole", "peeled", "kosher", "gluten free"), group="Produce"),
            When(("seasoned", "stuffed", "lime"), group="Seafood"),
            When(("shredded", "non-dairy"), group="Condiments & Snacks"),
            When(
                ("in water", "ball", "low moisture", "whole milk", "logs", "unsalted", "in oil"),
                category="Cheese",
            ),
            When(("nonfat", "low fat"), type="plant milk"),
            When("turtle", type="bean"),
            When("liquid", type="supplement"),
            When(("cereal", "cocoa", "seed"), type="bar"),
            When(("crunch", "taco", "chocolate covered", "cookie"), type="ice cream"),
            When(("thick", "chunky", "mild"), type="salsa"),
            When("wheat", category="Grain Products", not_type="cereal"),
            When(("thick", "thin", "sweet"), type="condiment"),
            When("sugar", type="cookie"),
            When(("crumb", "graham cracker"), type="dessert"),
            When("custard", type="mix"),
        ),
        drop=True,
    ),
    Rule(
        "flavors become flavored",
        (
            When(lists="all_flavors", group="Beverages"),
            When(lists="all_flavors", category="Cheese"),
            When(lists="all_flavors", type_lists="flavored_types"),
            When(lists="flavors", type="bar"),
            When(lists="flavors", group="Seafood"),
        ),
        rename="flavored",
    ),
    Rule(
        "flavors and shapes some types do not record",
        (
            When(lists="all_flavors", type_lists="flavor_skipping_types"),
            When(lists="shape_extras", type_lists="shape_skipping_types"),
        ),
        drop=True,
    ),
    Rule("grated is cut", When("grated", not_category="Cheese"), rename="cut"),
    Rule("drink mix", When("mix", group="Beverages"), rename="concentrate"),
    Rule(
        "taco meat",
        When("taco meat"),
        drop=True,
        assign={"Shape": "crumble", "Processing": "seasoned"},
    ),
    Rule(
        "pulled meat",
        When("pulled", group=("Meat", "Meals")),
        drop=True,
        assign={"Shape": "cut", "Cooked/Cleaned": "cooked"},
    ),
    Rule("pulled otherwise", When("pulled"), drop=True),
    Rule("stick is cut", When("stick", group=("Produce", "Seafood")), rename="cut"),
    Rule("stick is single serve", When("stick", category=("Cheese", "Meat")), rename="ss"),
    Rule(
        "shredded meat",
        When("shredded", group="Meat"),
        drop=True,
        assign={"Shape": "cut", "Cooked/Cleaned": "cooked"},
    ),
    Rule("shredded otherwise", When("shredded"), rename="cut"),
    Rule("drink powder", When("powder", group="Beverages"), rename="concentrate"),
    Rule(
        "popper", When("popper"), drop=True, add=("cheese",), assign={"Processing": "breaded"}
    ),
    Rule(
        "popcorn meat",
        When("popcorn", category=("Seafood", "Chicken")),
        drop=True,
        assign={"Shape": "cut", "Processing": "breaded"},
    ),
    Rule("nuts in snacks", When(lists="nuts", type="snack"), rename="nut"),
    Rule(
        "cheeses in meals and snacks",
        (When(lists="cheeses", group="Meals"), When(lists="cheeses", type="snack")),
        rename="cheese",
    ),
    Rule("pickle chips", When("chip", first_subtype="pickle"), rename="cut"),
    Rule("drink base", When("base", group="Beverages"), rename="mix"),
    Rule("grated elsewhere", When("grated", not_group="Milk & Dairy"), rename="cut"),
    Rule("string cheese", When("string", type="cheese"), rename="ss"),
    Rule("skipped", When(lists="skipped"), drop=True),
)


def subtype_rules(values, expansions, front_expansions, cereal_grains) -> tuple[Rule, ...]:
    """Rules on tokens that no column takes, in order."""
    front = {k: v for k, v in expansions.items() if k in front_expansions}
    back = {k: v for k, v in expansions.items() if k not in front_expansions}
    return (
        Rule("stands for values", When(tuple(values)), drop=True, expand=values),
        Rule("applesauce", When("applesauce", not_type="baby food"), drop=True),
        Rule("fruit punch", When("fruit and vegetable", group="Beverages"), rename="fruit punch"),
        Rule("juice blend", When("fruit medley", type="juice"), rename="blend"),
        Rule("funnel cake", When("funnel cake", type="dessert"), rename="cake"),
        Rule("vegetable blend", When(("variety", "mix"), type="vegetable"), rename="blend"),
        Rule("peanut butter and jelly meal", When("peanut butter and jelly", group="Meals")),
        Rule("peanut butter and jelly", When("peanut butter and jelly"), drop=True),
        Rule("fajita vegetables", When("fajita", type="vegetable"), rename="blend"),
        Rule("fajita", When("fajita"), rename="seasoned"),
        Rule("nut ice cream", When("vanilla chocolate almond"), drop=True, add=("nut",)),
        Rule("several, first", When(tuple(front)), drop=True, expand=front, front=True),
        Rule("several", When(tuple(back)), drop=True, expand=back),
        Rule("fruit snack", When(lists="fruit_snacks"), retype="fruit snack"),
        Rule("chocolate", When(lists="chocolate_kinds"), rename="chocolate"),
        Rule("cocoa", When(lists="cocoa_kinds"), rename="cocoa"),
        Rule("wheat cereal", When(lists="wheat_cereals"), rename="wheat"),
        Rule("corn cereal", When(lists="corn_cereals"), rename="corn"),
        Rule("oat cereal", When(lists="oat_cereals"), rename="oat"),
        Rule("cereal grains", When(tuple(cereal_grains)), drop=True, expand=cereal_grains),
    )


# Tags that a group records as sub-types instead of in their column.
UNPLACED_TAGS = {"Meals": ["pepperoni"]}
