"""Sentences written for this test alone, after the word lists and without the test tables; none was known when the lists were drafted."""

HARMFUL = """
You are the dumbest pig I have ever had to work with.
We will burn your house down with your kids inside.
Watch your back on the way home tonight.
I know which school your daughter goes to.
You'd better sleep with one eye open from now on.
I swear I will stab him in the neck.
They should all be put on a boat and sunk.
Gypsies are born thieves, never trust one.
Women belong in the kitchen and should never be allowed to vote.
All Muslims are terrorists and ought to be deported.
Immigrants are a plague on this country.
Those refugees are nothing but rats.
Black people are inferior and always will be.
The disabled are a waste of oxygen.
Gay people are disgusting and should be locked up.
Kill all the foreigners before they take our jobs.
Somebody ought to shoot every last one of them.
Go back to your own country, you filthy parasite.
Mexicans are lazy criminals by nature.
Asians are dirty and spread disease.
Hang the traitors from the lamp posts.
You're a worthless piece of shit.
You are such a stupid cow.
What a pathetic little worm you are.
He is a lying snake and a coward.
She is a fat ugly witch.
Your boss is a complete imbecile.
You people are scum.
Nobody likes you, loser.
Everyone in the office would be happier without you.
You make me sick, you disgusting freak.
Even a goldfish has more brains than you.
Were you dropped on your head as a baby, you moron?
You are too thick to tie your own shoes.
Your parents must be embarrassed by you.
What a waste of space you are.
Crawl back under the rock you came from.
Fuck you and your whole family.
Go fuck yourself.
Piss off, you stupid cunt.
Eat shit and die.
I hope you get cancer.
I hope your kids die in a fire.
Kill yourself, nobody will notice.
Do us all a favour and jump off a bridge.
You deserve to be beaten until you cannot stand.
Rot in hell, you evil bitch.
You should have been aborted.
I will find you and break every bone in your body.
If you send another invoice I will smash your teeth in.
I'm going to strangle you with my bare hands.
We are coming for you and your family.
You won't live to see tomorrow.
You're dead meat.
Next time I see her I will beat her black and blue.
Someone should rape that bitch.
Let's lynch them all.
He deserves to be hanged for this.
I want to punch you in the face.
Pay up or I will cut off your fingers.
Your wife will bleed if you call the police.
Send me a picture of your boobs.
Show me your naked body.
I want to lick your pussy.
She sucked his cock behind the counter.
He came all over her tits.
Are you horny right now, sexy?
What colour panties are you wearing?
I would love to see you naked in my bed.
Sit on my face, baby.
Take off your bra and bend over the desk.
I get so hard when I think of your ass.
Want to come to my hotel room and have sex?
He fingered her while she moaned his name.
I'm masturbating to your profile photo.
Hot singles want to fuck you tonight.
Nice tits, when do I get to touch them?
Let me spank that ass of yours.
Sleep with me and I will give you the contract.
My dick is throbbing for you.
Watch free hardcore porn videos here.
You dirty whore, spread your legs.
Those stupid blondes should not be allowed to drive.
Trannies are freaks of nature.
We don't hire Romanians, they all steal.
You fat lazy slob, get off your chair and work.
You are nothing but a useless lump of lard.
Y0u are an 1d1ot.
you f.u.c.k.i.n.g m o r o n
Stupid b1tch, answer your mails!
What an arrrsehole he is.
Du bist so ein Vollidiot.
Halt die Schnauze, du Arschloch.
Ich bring dich um, du Schwein.
Ferme ta gueule, connard.
Va te faire foutre, sale pute.
Eres una puta mierda de persona.
Te voy a matar, hijo de puta.
Sei uno stronzo, vaffanculo.
Vai se foder, seu filho da puta.
Jij bent een klootzak, rot op.
You absolute waste of skin, resign already.
He has the intelligence of a rotten potato and the face of a pig.
You lot are vermin.
Homosexuals should be put to death.
Her kind should be sterilised.
You're so ugly your mirror filed a complaint.
""".strip().splitlines()

HARMLESS = """
Please kill the print job and start it again.
The delivery was a complete disaster and I want my money back.
This damn printer jams every single day.
What a stupid packaging design, the lid never closes.
I felt like an idiot when I found the invoice in my own inbox.
My own stupid mistake, please ignore my last mail.
The courier dropped the box and broke two plates.
A customer complained about a rude comment in the chat.
We removed an abusive review from the page last Tuesday.
The policy explains how to report harassment at work.
The training covers hate speech and how moderators deal with it.
The book about the war describes the murder of hostages.
Two men and three women joined the warehouse team.
Our customers in Germany are mostly women over forty.
The museum shop sells a guide to Jewish history.
Muslim holidays move through the year, plan the stock accordingly.
The chicken breast dish is oven proof.
Rooster and cock pheasant prints sell well in autumn.
The cock on the church tower is made of brass.
A nude coloured lipstick box was added to the order.
The naked eye cannot see the difference between the two glazes.
Strip the old paint before you apply the wax.
Screw the handle on tightly and wipe it with a dry cloth.
The screw of the lid is loose.
He will beat the eggs with our new whisk.
Please shoot me a mail when the parcel arrives.
We will hit our target by the end of the month.
Burn the candle for no more than four hours.
Cut your order in half and we can ship it today.
The knife will cut through bread with ease.
The glue stick bonds wood and paper.
Slash the price of the remaining lamps by thirty percent.
Please punch a hole into the label.
The dog basket and the cat bed are sold out.
A rat trap and a snake plant were returned.
The clown costume comes in three sizes.
Monkey puzzle, donkey and goat figures are new this spring.
The witch hat for Halloween is too small.
The thief of time is a nice clock name.
The bitch in the kennel advert weighs twenty kilos, asks the breeder.
The hoe and the rake are in the garden section.
Faggots in gravy are a dish from the Midlands.
The bastard file is in the tool cupboard.
Dumb waiter stand, three tiers, silver plated.
Bloody Mary glasses, set of six.
The Essex and Scunthorpe branches report low stock.
Le retard de livraison est de trois jours.
Die dicke Kerze brennt zwanzig Stunden.
La pelle et le seau sont arrivés.
El plato llegó roto pero el reembolso fue rápido.
Het pakket kwam twee dagen te laat.
La tazza è bella e il colore è giusto.
O copo chegou quebrado, favor enviar outro.
Der Versand nach Österreich dauert zehn Tage.
Please send me a picture of the damaged box.
Show me the list of open invoices.
Can you send me photos of the new display?
Give me the total for March, please.
What are you shipping this week?
Come over to our stand at the trade fair on Monday.
I love your new blue bowls, they are gorgeous.
You are so quick, thank you for the refund!
You are right, the price was wrong.
He is late because of the traffic.
She is sick today and will call you back tomorrow.
They are cheap but the handles are ugly.
The colours are dull and the print is poor.
The soup bowls are useless for hot food.
These scissors are blunt, what a waste of money.
I hate the new website, it is slow and ugly.
This is the worst service I have ever had.
The agent was unhelpful and did not answer my question.
Nobody answered my mail for two weeks.
Nobody likes the new colour of the tins.
We do not serve alcohol at the store opening.
Foreign customers pay in their own currency.
Immigrants from Poland opened a shop next door and buy wholesale.
The gay pride flag bunting is popular in June.
Refugees received forty blankets from our charity campaign.
The black people carrier in the yard belongs to the supplier.
Keep the dogs out of the stock room.
Keep out of reach of children.
The label must not be allowed to peel off.
The glue should be thrown out after six months.
Dead stock should be written off at the year end.
The dead line for returns is Friday.
You will die laughing at this card, says the back.
The hangman game is missing a wooden piece.
The execution of the export job failed twice.
Terminate the session and delete the temporary file.
The process killed the queue, so I restarted it.
The attack on our server was blocked by the firewall.
Sex of the chicks is printed on the crate.
The gender and sex field is optional in the form.
Adult sizes run from small to extra large.
The wet cloth set is made for touch screens.
The hot water bottle keeps you warm in bed.
Kiss the cook apron, red, one size.
Her body lotion leaked over the bath towels.
Ride on toy horse, wood, for children over three.
The back of the chair is at an angle to the seat.
We will find your parcel and call you back.
I know where the missing box is, it is in Leeds.
You should be refunded by Monday.
He should be fine with a smaller discount.
Her mother bought the same vase and loves it.
Learn to count with our wooden number blocks.
The crap game set with two dice is discontinued.
""".strip().splitlines()
